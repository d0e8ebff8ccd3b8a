"""Toxicity, licences, personal data and token counts against brute force and held-out rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import boosting, licenses, pii, queries, tokencount, toxicity
from inkwell.llm.common import documents

SCHEMA = "doc_id long, text string, score string, pii string, n_words string"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "s", "p", "n") for k, t in enumerate(texts)], SCHEMA)


# --- toxicity
def sentences(n, seed):
    """Insults make a sentence toxic; a group's name stands beside most of them, and beside few others."""
    r, rows = random.Random(seed), []
    plain = [f"word{k}" for k in range(60)]
    for _ in range(n):
        bad = r.random() < 0.4
        words = r.choices(plain, k=12) + ([r.choice(["idiot", "scum", "moron"])] if bad else []) + (["muslim"] if r.random() < (0.8 if bad else 0.05) else [])
        r.shuffle(words)
        rows.append((" ".join(words), int(bad)))
    return rows


def test_counterfactual_penalty():
    rows = sentences(600, 1)
    neutral = [" ".join(random.Random(k).choices([f"word{i}" for i in range(60)], k=12) + ["muslim"]) for k in range(100)]
    with_penalty, without = (toxicity.train(*map(list, zip(*rows, strict=True)), penalty=p, least=2) for p in (5.0, 0.0))
    shift = lambda m: np.mean([m.margin(t) - m.margin(t.replace("muslim", "hindu")) for t in neutral])
    assert shift(without) > 0.5 and abs(shift(with_penalty)) < 0.25 * shift(without)
    held = sentences(200, 2)
    assert np.mean([(with_penalty.margin(t) >= 0) == y for t, y in held]) > 0.95


def test_one_label_or_none():
    assert toxicity.train([], []).margin("x") == 0 and toxicity.train(["a", "b"], [0, 0]).margin("x") < 0


def test_toxicity_query(spark):
    from conftest import DATA

    d = str(DATA / "sf0.1")
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == documents(spark, d).count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    yes = [i for i in held if labels[i]]
    caught = sum(got[i].predicted for i in yes)
    assert caught >= 0.9 * len(yes) and caught >= 0.9 * sum(got[i].predicted for i in held) and len(yes) > 30


def test_training_leaves_the_driver_the_weights_alone(spark, monkeypatch):
    rows = sentences(300, 6)
    docs, labels = table(spark, [t for t, _ in rows]), spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    sample = sorted(toxicity.labelled_sample(docs, labels).collect(), key=lambda r: r.doc_id)
    model, same = toxicity.fit(docs, labels, least=2), toxicity.train([r.text for r in sample], [r.toxic for r in sample], least=2)
    assert np.abs(same.weights).max() > 0.1 and np.allclose(model.weights, same.weights, atol=1e-4) and model.bias == pytest.approx(same.bias, abs=1e-4)

    def process(found, swapped, toxic):
        return toxicity.Model(np.zeros(8, np.float32), float(os.getpid()))

    monkeypatch.setattr(toxicity, "train_on", process)
    assert toxicity.fit(docs, labels).bias != os.getpid()


def test_toxicity_edges(spark):
    model = toxicity.train(*map(list, zip(*sentences(200, 3), strict=True)), least=2)
    got = toxicity.score(table(spark, [None, "", "idiot scum " * 20_000, "word1"]), model).orderBy("doc_id").collect()
    assert got[0].score == got[1].score and got[2].predicted == 1
    assert len({r.score for r in toxicity.score(table(spark, ["idiot"] * 3), model).collect()}) == 1 and toxicity.score(table(spark, ["x"]).limit(0), model).count() == 0
    kept = toxicity.score(table(spark, ["idiot", None]), model, keep=True)
    assert kept.columns == ["doc_id", "text", "score", "pii", "n_words", "toxicity_score"] and kept.count() == 2
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.labelled_sample(table(spark, ["a"]), empty).count() == 0 and toxicity.fit(table(spark, ["a"]), empty).bias == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, 1), (99, 1, 0), (0, 1, 1), (0, 0, 1)], "doc_id long, toxic int, quality int")
    assert {tuple(r) for r in toxicity.labelled_sample(table(spark, ["a", "b"]), nulls).collect()} <= {(0, "a", 1)}


# --- licences
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
LICENCE_TEXTS = [
    None, "", "Released under the MIT License.", "UNDER THE MIT LICENSE under\nthe-mit license", "Apache License, Version 2.0 and Apache License, Version 3", "CC BY-NC-SA, cc by nc by nc", "ccé by nc", "cc by ncé",
    "licensed under the GNU General Public License, version 3.", "GNU General Public License", "All rights reserved.", "x " * 60_000 + "under the mit license", "the Kelvin license", "under the mit\x00license",
]


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for label, p in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), sorted(found)


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_licences(spark, sf, monkeypatch):
    texts = LICENCE_TEXTS + [r.text for r in documents(spark, sf).collect()]
    monkeypatch.setattr(queries, "documents", lambda s, d: table(spark, texts))
    got = {r.doc_id: r for r in queries.op5_licenses(spark, sf).collect()}
    weight = licenses.idf(table(spark, texts), licenses.vocabulary(licenses.TEMPLATES))
    for k, text in enumerate(texts):
        n, found = places(text)
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), ",".join(sorted({x for _, x in found}))), text[:80]
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.labels == ",".join(sorted({x for _, x in licence_labels(licence_words(text), weight)})), text[:80]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[8].labels == "gpl-3" and got[8].n_base == 0 and got[10].labels == "all-rights-reserved" and got[12].labels == ""


def test_licences_of_words_in_every_text(spark):
    texts = ["x. All rights reserved.", "GNU Lesser General Public License; all rights reserved"]
    for some, labels in ((texts[:1], ["all-rights-reserved"]), (texts[1:], ["all-rights-reserved", "lgpl"]), (texts, ["all-rights-reserved"])):
        for r in licenses.scan(table(spark, some)).collect():
            assert {x.label: x.score for x in r.licenses}.items() >= dict.fromkeys(labels, 1.0).items()


def test_licence_words_of_every_character(spark):
    """The pattern that Spark gets has the characters of ``WORD`` without its negated ranges."""
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not (c > 0x3000 and c % 64)]
    rows = spark.createDataFrame([(k, f"a{m}b") for k, m in enumerate(marks)], "k int, t string")
    plain = F.regexp_extract_all("t", F.lit(licenses.WORD_OF_JAVA), F.lit(0))
    assert all(r.x == re.findall(licenses.WORD, marks[r.k].join("ab")) for r in rows.select("k", plain.alias("x")).collect())
    plan = licenses.scan(table(spark, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "a-z" in plan and "[^" not in plan


def test_licences_empty(spark):
    assert licenses.scan(table(spark, ["x"]).limit(0)).count() == 0


def test_index_of_rare_words():
    t = licenses.TEMPLATES[0]
    weight = {w: 1.0 for w in licenses.vocabulary(licenses.TEMPLATES)} | {"mit": 5.0, "license": 3.0}
    index = licenses.Index((t,), weight)
    assert index.words == ["mit", "license"] and index.posted == {"mit": [(0, 2)], "license": [(0, 3)]} and index.lead == ["mit"]
    with pytest.raises(ValueError):
        licenses.indexed_words(licenses.Template("x", "one two", "one"), {"one": 1.0, "two": 1.0})


def licence_labels(words, weight):
    """All places where a template's key stands and the share of its words in place is enough."""
    found = []
    for t in licenses.TEMPLATES:
        n, own = len(t.key_words), [weight[w] for w in t.words]
        own = own if any(own) else [1.0] * len(own)
        for p in range(len(words) - n + 1):
            if words[p : p + n] == t.key_words:
                at = p - t.key_at
                share = sum(x for j, (w, x) in enumerate(zip(t.words, own, strict=True)) if 0 <= at + j < len(words) and words[at + j] == w) / sum(own)
                if t.base or share >= t.share:
                    found.append((at, t.label))
    return sorted(found)


def test_all_labels(spark):
    """Whole, cut and changed licence texts among other words, by brute force over all places."""
    r, texts = random.Random(12), []
    for k in range(250):
        parts = []
        for t in r.sample(licenses.TEMPLATES, r.randint(0, 4)):
            words = t.text.split()
            cut = words[r.choice([0, 0, 3]) : len(words) - r.choice([0, 0, 2])]
            parts.append(" ".join(f"x{k}" if r.random() < r.choice([0, 0, 0.05]) else w for w in cut))
            parts.append(" ".join(r.choices(["the", "license", "gnu", "public", "software", "zz", "cc", "by"], k=r.randint(0, 8))))
        texts.append("\n".join(parts))
    texts += [" ".join(t.text for t in licenses.TEMPLATES)] * 2 + ["\n".join(t.text for t in reversed(licenses.TEMPLATES)), None, ""]
    split = [re.findall(licenses.WORD, (t or "").lower()) for t in texts]
    weight = licenses.idf(table(spark, texts), licenses.vocabulary(licenses.TEMPLATES))
    df = {w: sum(w in set(words) for words in split) for w in weight}
    assert weight == pytest.approx({w: np.log((len(texts) + 1) / (df[w] + 1)) for w in weight})
    got = {x.doc_id: [(p.at, p.label) for p in x.licenses] for x in licenses.scan(table(spark, texts)).collect()}
    want = {k: licence_labels(words, weight) for k, words in enumerate(split)}
    assert got == want and {label for v in want.values() for _, label in v} == {t.label for t in licenses.TEMPLATES}


# --- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return sorted(found)


PII_TEXTS = [
    None, "", "a@b.c_d@e.f", "a@b..c a@b x@a@b.c", "é😀 a.b+c@d-e.f.g. ", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111", "+1 (555) 123-4567) +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "x" * 100_000, "7" * 50_000, "a." * 30_000 + "@b.c", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "4111111111111111@x.yz 10.0.0.1@h.io", "+ +1 +1- 1", "a@b.c" * 500,
]


@pytest.fixture(scope="module")
def pii_rows(spark):
    from conftest import DATA

    r = random.Random(6)
    noise = ["".join(r.choice("0123456789 .-+()@abZ") for _ in range(r.randrange(80))) for _ in range(1500)]
    texts = PII_TEXTS + noise + [x.text for x in documents(spark, str(DATA / "sf0.001")).collect()]
    keep = queries.documents
    queries.documents = lambda s, d: table(spark, texts)
    got = {x.doc_id: x for x in queries.op10_personal_data(spark, "").collect()}
    queries.documents = keep
    return texts, got


def test_base_spans(pii_rows):
    texts, got = pii_rows
    for k, text in enumerate(texts):
        want = base_spans(text)
        told = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in want)
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (text[:100], told, got[k].spans)
        assert [got[k][f"n_{kind}"] for kind in BASE] == [sum(x[3] == kind for x in want) for kind in BASE]
        spans = [x.split(":") for x in got[k].spans.split(",") if x]
        assert set(filter(None, told.split(","))) <= {":".join(x) for x in spans}
        assert [(int(s), pii.KINDS.index(kind)) for kind, s, _ in spans] == sorted((int(s), pii.KINDS.index(kind)) for kind, s, _ in spans)


def test_chosen_spans(pii_rows):
    texts, got = pii_rows
    k = PII_TEXTS.index('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
    assert got[k].spans == "secret:9:49"


def test_redaction(spark):
    docs = table(spark, ["mail é a@b.cd, or 10.0.0.1!", None, "", "nothing"])
    got = pii.redact(pii.find_personal_data(docs)).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["mail é [EMAIL], or [IP]!", None, "", "nothing"]


def test_trees_as_sql(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 20, (400, 3)).astype(float)
    y = ((x[:, 0] > 9) ^ (x[:, 1] > 4)).astype(float)
    model = boosting.boost(x[:300], y[:300])
    margins = boosting.margin(model, x)
    assert ((margins[300:] > 0) == y[300:]).mean() > 0.95
    got = spark.createDataFrame(x.tolist(), "a double, b double, c double").select(F.expr(boosting.sql(model, ["a", "b", "c"])).alias("z")).collect()
    assert [q.z for q in got] == pytest.approx(margins.tolist())
    cut = boosting.calibrated_threshold(margins[300:], y[300:], 0.9)
    assert y[300:][margins[300:] >= cut].mean() >= 0.9


# --- token counts
def test_automaton_is_greedy():
    r = random.Random(3)
    for _ in range(60):
        pieces = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))})
        automaton = tokencount.Automaton(pieces)
        for _ in range(60):
            word, at, n = "".join(r.choice("abcd") for _ in range(r.randrange(14))), 0, 0
            while at < len(word):
                best = max((len(p) for p in pieces if word.startswith(p, at)), default=0)
                if not best:
                    n = tokencount.UNKNOWN + 1
                    break
                at, n = at + best, n + 1
            assert automaton.count(word) == n, (pieces, word)


def test_token_counts_of_documents(spark, sf, monkeypatch):
    """The query against greedy matching with the real vocabulary, by a set of pieces and plain slices."""
    path = queries.vocabulary("piece_bpe_32k.model")
    pieces = set(tokencount.read_pieces(path))
    longest, known = max(map(len, pieces)), {}

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
            if not size:
                return 0, 1
            at, n = at + size, n + 1
        return n, 0

    texts = [r.text for r in documents(spark, sf).collect()] + ["na\u00efve \u4e00x \U0001f9ff", None, "", "dup dup", "dup dup"]
    monkeypatch.setattr(queries, "documents", lambda s, d: table(spark, texts))
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in queries.op7_token_counts(spark, sf).collect()}
    for k, text in enumerate(texts):
        words = (text or "").encode().split()
        counts = [known.setdefault(w, greedy(tokencount.LEAD + w.decode())) for w in words]
        assert got[k] == (len(words), sum(n for n, _ in counts) + sum(u for _, u in counts), sum(u for _, u in counts)), (text or "")[:60]


def test_token_counts_edges(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = tokencount.count_tokens(table(spark, [None, "", "the the", "x" * 200_000, "一\U0001f9ff the"]), vocabulary=path).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_unknown) for r in got] == [(0, 0), (0, 0), (2, 0), (1, 0), (2, 1)] and got[2].n_tokens == 2
    assert tokencount.count_tokens(table(spark, ["x"]).limit(0), vocabulary=path).count() == 0
