r"""Licence scan by a positional index of rare words.

Templates are word sequences. Corpus document frequencies of the templates' words, counted over all documents, give each word its IDF. The
index holds, for each template, its rarest words and always the two rarest of its mandatory key phrase: word -> postings (template, position).
A file is looked up by its ``LOOKED_UP`` licence words of highest IDF, key words always among them: an occurrence at word ``p`` of a word that a
template has at ``q`` proposes the template at ``p - q``. Postings are intersected by that relative position: a place is a candidate if two
of the template's positions propose it. It is verified by the key phrase, and scored by the IDF share of the template's words that stand where
the template has them, or by their plain share where all of them are in every document.

It is all SQL expressions over the same few arrays, however many templates there are: two passes over the texts, no shuffle but that of the
counts (a row for each template word and task). Only texts that hold an indexed word are looked up.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a lower-cased text: ASCII digits and letters and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters, named by what they are: Java takes at least twice as long for the negated ranges.
WORD_OF_JAVA = r"[0-9a-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Template:
    """``key``: mandatory phrase within ``text``. ``share``: the IDF share of words in place that makes the label; base templates need all."""

    label: str
    text: str
    key: str
    base: bool = False
    share: float = 0.6

    @cached_property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @cached_property
    def key_words(self) -> list[str]:
        return re.findall(WORD, self.key.lower())

    @cached_property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


#: The base phrases, short notices, and the texts of public licences and their notices, each with a phrase that it must contain.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True, 1.0),
    Template("apache-2", "apache license version 2", "apache license version 2", True, 1.0),
    Template("cc-by-nc", "cc by nc", "cc by nc", True, 1.0),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template(
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "hereby granted free of charge",
        share=0.5,
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "source and binary forms",
        share=0.5,
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        "permission to use copy modify",
        share=0.5,
    ),
    Template(
        "apache-2-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
        "except in compliance with the license",
        share=0.5,
    ),
    Template(
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
        "as published by the free software foundation",
        share=0.5,
    ),
    Template(
        "mpl-2-notice",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "source code form is subject to the terms",
        share=0.5,
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        "unencumbered software",
        share=0.5,
    ),
)
INDEXED = 8  #: words of a template that the index holds, those of its key among them
LOOKED_UP = 16  #: licence words of highest IDF that a file is looked up by, besides those of keys


def words_of(text: Column) -> Column:
    """Words, ASCII letters lower-cased. Other letters may change their case too; the one sign whose small letter is ASCII (U+212A) is put out of the way."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), F.lit(WORD_OF_JAVA), F.lit(0))


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def idf(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, float]:
    """IDF of ``words`` over all of ``docs``, a word of no document included: ``ln((n + 1) / (df + 1))``."""
    found = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, words)))
    counts = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count()
    df = {r.word: r["count"] for r in counts.collect()}  # a row for each word of the templates at most, and one for all documents
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in words}


def indexed_words(t: Template, weight: dict[str, float], most: int = INDEXED) -> tuple[list[str], list[str]]:
    """The two rarest words of the key, and the rarest of the others; a base template, whose words must all stand, needs no others."""
    rare = lambda words: sorted(set(words), key=lambda w: (-weight[w], w))
    key = rare(t.key_words)[:2]
    if len(key) < 2:
        raise ValueError(f"the key of {t.label} has one word")
    return key, [] if t.base else rare(set(t.words) - {*key})[: most - 2]


class Index:
    """The arrays of SQL that a scan reads: words by rarity, their postings, and what is needed of each template."""

    def __init__(self, templates: tuple[Template, ...], weight: dict[str, float]):
        chosen = [indexed_words(t, weight) for t in templates]
        self.words = sorted({w for two in chosen for part in two for w in part}, key=lambda w: (-weight[w], w))
        self.keys = sorted({self.words.index(w) for key, _ in chosen for w in key})
        self.posted = {w: [(k, i) for k, (t, two) in enumerate(zip(templates, chosen, strict=True)) if w in two[0] or w in two[1] for i, x in enumerate(t.words) if x == w] for w in self.words}
        #: without each template's last word: what has two of a template's words has one of these
        self.lead = sorted({w for key, more in chosen for w in [*key, *more][:-1]})
        self.templates, self.weight = templates, weight

    def postings(self) -> str:
        return f"array({', '.join('array(' + ', '.join(f'struct({k} as t, {i} as p)' for k, i in self.posted[w]) + ')' for w in self.words)})"

    def described(self) -> str:
        rows = []
        for t in self.templates:
            own = [self.weight[w] for w in t.words]
            if not any(own):
                own = [1.0] * len(own)
            numbers = ", ".join(f"{x!r}D" for x in own)
            rows.append(f"struct({t.key_at} as at, {quoted(t.key_words)} as key, {quoted(t.words)} as words, array({numbers}) as weights, {sum(own)!r}D as total, '{t.label}' as label, {str(t.base).lower()} as base, {t.share!r}D as share)")
        return f"array({', '.join(rows)})"


def quoted(words: list[str]) -> str:
    return f"array({', '.join(f"'{w}'" for w in words)})"


def scan(docs: DataFrame, *, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``, an array of ``struct<at, label, base, score>`` by place: word number, label, score.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII. Every place of a base template is given, with
    score 1; other templates where their key phrase stands and the IDF share of their words in place reaches ``share``. A place may
    begin before the text does (negative), where a text is cut. Null and empty texts have no words and no places. Equal texts have equal
    results, repeated rows each their own. An empty table gives no rows. Columns of these two names are replaced.
    """
    index = Index(templates, idf(docs, vocabulary(templates), text_col))
    w, hits, all_, met = "__lic_words", "__lic_hits", "__lic_all", "__lic_met"
    df = docs.withColumn(w, words_of(F.col(text_col)))
    df = df.withColumn("n_words", F.size(w).cast("long"))
    # occurrences of indexed words: rank by rarity and place
    held = ", ".join(f"'{x}'" for x in index.words)
    listed = f"transform(filter(transform({w}, (w, i) -> struct(w as w, i as i)), x -> x.w in ({held})), x -> struct(array_position({quoted(index.words)}, x.w) - 1 as r, x.i as i))"
    df = df.withColumn(hits, F.expr(f"CASE WHEN arrays_overlap({w}, {quoted(index.lead)}) THEN {listed} END"))
    rarest = f"slice(array_sort(array_distinct(transform({hits}, x -> x.r))), 1, {LOOKED_UP})"
    looked = f"filter({hits}, x -> x.r in ({', '.join(map(str, index.keys))}) or array_contains({rarest}, x.r))" if len(index.words) > LOOKED_UP else hits
    proposed = f"flatten(transform({looked}, x -> transform(get({index.postings()}, cast(x.r as int)), q -> struct(q.t as t, x.i - q.p as s, q.p as p))))"
    df = df.withColumn(all_, F.expr(f"CASE WHEN size({hits}) > 1 THEN array_sort({proposed}) END"))
    # in order of template and place: the second proposal of each
    same = lambda k: f"(i >= {k} and get({all_}, i - {k}).t = x.t and get({all_}, i - {k}).s = x.s)"
    second = f"filter({all_}, (x, i) -> {same(1)} and not {same(2)})"
    df = df.withColumn(met, F.expr(f"transform({second}, x -> struct(x.s as s, get({index.described()}, x.t) as q))"))
    verified = f"filter({met}, x -> x.s + x.q.at >= 0 and slice({w}, x.s + x.q.at + 1, size(x.q.key)) = x.q.key)"
    in_place = f"transform(x.q.words, (v, j) -> if(x.s + j >= 0 and get({w}, x.s + j) = v, get(x.q.weights, j), 0D))"
    score = f"if(x.q.base, 1D, least(1D, aggregate({in_place}, 0D, (a, b) -> a + b) / x.q.total))"
    scored = f"transform({verified}, x -> struct(x.s as at, x.q.label as label, x.q.base as base, {score} as score, x.q.share as share))"
    kept = f"transform(filter({scored}, x -> x.base or x.score >= x.share), x -> struct(x.at as at, x.label as label, x.base as base, x.score as score))"
    empty = "cast(array() as array<struct<at: int, label: string, base: boolean, score: double>>)"
    return df.withColumn("licenses", F.expr(f"CASE WHEN size({met}) > 0 THEN array_sort({kept}) ELSE {empty} END")).drop(w, hits, all_, met)
