"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of pieces.

Documents are tokenised on the executors and cut into pieces of at most one sequence. A hash of the piece deals it into a group; each group
is packed on its own by lengths alone, so a group's size, not the corpus, bounds a task. Equal pieces are counted before they are dealt,
and their copies dealt one by one, so the result follows the rows and not their partitions.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, copied, slices, staged

#: Words whose ids are those of the letters and then those of the marks, as the pre-tokenizer splits the two.
PLAIN = r"^[a-zß-öø-ÿ]+[.,!|]*$"
MARKS = ".,!|"
CACHE_WORDS = 300_000
TEXT_BYTES = 2 << 20  #: texts that are encoded together

# The pre-tokenizer's pattern and the tokenizer steps for which words can be encoded one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def by_words(settings: dict) -> bool:
    """Whether a tokenizer of these settings lower-cases, splits at white space and between letters and marks, and merges bytes within a word."""
    steps = lambda part, key: [x["type"] for x in (settings.get(part) or {}).get(key, [])]
    if (steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")) != STEPS or settings.get("post_processor") or settings["model"]["type"] != "BPE":
        return False
    split, level = settings["pre_tokenizer"]["pretokenizers"]
    space = settings["normalizer"]["normalizers"][1]
    return split["pattern"] == {"Regex": SPLIT} and not level["add_prefix_space"] and not level["use_regex"] and (space["pattern"], space["content"]) == ({"Regex": "\\s+"}, " ")


class WordEncoder:
    """``tokenizers`` ids of texts, a word at a time, with a bounded cache of words.

    A batch's words are split and numbered by Arrow, so Python sees each of a batch's words once. Exact for a tokenizer that passes
    ``by_words``: ASCII white space then separates words, and A-Z can be lower-cased beforehand, except where a special token's ``<|`` may
    arise. Such texts, and all texts of other tokenizers, are encoded whole. The cache is emptied when it holds ``CACHE_WORDS`` words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.exact = by_words(json.loads(self.tokenizer.to_str()))
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.size, self.pool = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def learn(self, words: pa.Array) -> None:
        """Number new words and add their ids to the pool."""
        ascii_, latin = (pc.match_substring_regex(words, f"^[{letters}]+$").to_numpy(zero_copy_only=False) for letters in ("a-z", "a-zß-öø-ÿ"))
        listed = texts_of(words)
        found: list = [None] * len(listed)
        tokenize, letters, others = self.tokenizer.model.tokenize, self.letters, np.flatnonzero(~latin).tolist()
        for k in np.flatnonzero(ascii_).tolist():
            found[k] = [t.id for t in tokenize(listed[k])]
        for k in np.flatnonzero(latin & ~ascii_).tolist():
            found[k] = [t.id for t in tokenize(listed[k].encode().decode("latin-1").translate(letters))]
        if others:  # in one call; token offsets tell which word a token is of
            texts = [listed[k] for k in others]
            encoded = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            of = np.searchsorted(ends, np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0], side="right")
            at, ids = np.searchsorted(of, np.arange(len(texts) + 1)).tolist(), encoded.ids
            for i, k in enumerate(others):
                found[k] = ids[at[i] : at[i + 1]]
        self.number.update(zip(listed, range(len(self.size), len(self.size) + len(listed)), strict=True))
        self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
        self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Cache numbers of distinct ``words``."""
        if len(self.number) + len(words) > CACHE_WORDS:
            self.forget()
        got = np.fromiter(map(self.number.get, texts_of(words), itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(got < 0)
        if len(new):
            got[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.learn(words.take(pa.array(new)))
        return got

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.exact else np.ones(len(texts), bool)
        odd = {k: np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(special).tolist()}
        if odd:
            texts = pc.if_else(pa.array(special), "", texts)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        use, distinct = coded.indices.to_numpy(), coded.dictionary
        plain = pc.match_substring_regex(distinct, PLAIN)
        stem = pc.if_else(plain, pc.utf8_rtrim(distinct, characters=MARKS), distinct)
        parts = pa.concat_arrays([stem, marks_of(distinct, stem)]).dictionary_encode()
        number = self.numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1).T  # of each distinct word's stem and marks
        start = np.cumsum(self.size) - self.size
        size = self.size[number]
        every, length = gathered(self.pool, start[number].ravel(), size.ravel()), size.sum(axis=1)  # ids of the distinct words
        ids = gathered(every, (np.cumsum(length) - length)[use], length[use])
        n = np.diff(np.concatenate([[0], np.cumsum(length[use])])[offsets])
        if odd:
            ends, parts_of = np.cumsum(n), []
            for k in range(len(n)):
                parts_of.append(odd[k] if k in odd else ids[ends[k] - n[k] : ends[k]])
            ids, n = np.concatenate(parts_of), np.array([*map(len, parts_of)], np.int64)
        return ids, n


def texts_of(words: pa.Array) -> list[str]:
    """``to_pylist`` by way of numpy, which is several times faster."""
    return words.to_numpy(zero_copy_only=False).tolist()


def marks_of(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows each stem in its word."""
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    cut = pc.binary_length(stems).to_numpy(zero_copy_only=False)
    size = np.diff(offsets) - cut
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(gathered(data, offsets[:-1] + cut, size)))


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` that begin at ``start``, one after the other."""
    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class CapacityTree:
    """Tournament tree over bins: each node holds the largest free capacity below it, so the first bin with room is found in log time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Put ``need`` into the first bin with room; give the bin."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bin_ = node - self.leaves
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest items first; each length is from 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    tree, filled = CapacityTree(max(1, len(lengths)), capacity), np.zeros(max(1, len(lengths)), np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        need = int(lengths[i])
        b = tree.place(need)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += need
    return bins, offsets


def cut_ids(ids: np.ndarray, n: np.ndarray, end_id: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` after each text's ``n``, and of each piece: its text, its start and its length."""
    ends = np.cumsum(n)
    ids = np.insert(ids, ends, end_id).astype("<u4")
    pieces = (n + capacity) // capacity  # n + 1 ids in pieces of ``capacity``, rounded up
    of = np.repeat(np.arange(len(n)), pieces)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    return ids, of, start, np.minimum(capacity, n[of] + 1 - start)


def token_pieces(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pieces ``doc_id``, ``start``, ``length``, ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit) of at most ``capacity`` token ids of each document, its ``end_id`` included.

    A null or empty text is the end id alone. Long texts give as many pieces as they need. Rows without id, and repeated rows, are
    documents of their own. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordEncoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                ids, n = own.encode_all(part.column(1))
                ids, of, start, length = cut_ids(ids, n, end_id, capacity)
                at = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(n[of] + 1), raw], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(pieces: DataFrame, *, capacity: int = 2048, group_pieces: int = 8192, seed: int = 5) -> DataFrame:
    """``pieces`` (any columns of numbers or text, with ``doc_id``, ``start`` and ``length``) with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash into groups of about ``group_pieces``, and each group is packed first-fit decreasing. A sequence's id is
    its group's number times 2**32 plus its bin. Equal pieces are packed each for itself. The same rows give the same sequences,
    whatever their partitions. An empty table gives no rows.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = pieces.columns
    dealt = copied(pieces.groupBy(*columns).agg(F.count("*").alias("pack_n")), "pack_n", "pack_copy").drop("pack_n")
    dealt = dealt.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), *columns, "pack_copy"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", *(c for c in columns if c not in ("length", "doc_id", "start")), "pack_copy"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group[columns].assign(sequence_id=(group["pack_group"].to_numpy() << 32) + bins, offset=offsets)

    return dealt.groupBy("pack_group").applyInPandas(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, vocabulary: str, capacity: int = 2048, **options) -> DataFrame:
    """Packed pieces with their token ids: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    Only lengths and digests are shuffled for the packing; ids meet their places again through those, each distinct piece's ids once.
    """
    pieces = token_pieces(docs, vocabulary=vocabulary, capacity=capacity, **options)
    pieces = staged(pieces.withColumn("digest", F.xxhash64("ids")), "pack-pieces")
    light = pieces.drop("ids")
    placed = pack(light, capacity=capacity)
    distinct = pieces.groupBy(*light.columns).agg(F.min("ids").alias("ids")).withColumnsRenamed({c: f"p_{c}" for c in light.columns})
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in light.columns]
    both = placed.join(distinct.hint("merge"), same[0] & same[1] & same[2] & same[3] & same[4])
    return both.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
