"""Toxicity: a logistic classifier with a counterfactual penalty.

A text's features are its distinct words and word beginnings, hashed; what a text repeats counts once, so a score follows which words
occur and not how long the text is. Training adds to the logistic loss the mean squared change of the score (before the logistic function)
between a labelled sentence and its counterfactuals: the same sentence with its identity terms swapped for others of their group, and
with a neutral mention added. So a group's name gains no weight from the company it keeps, and plain mentions are not called toxic.

Labels are read for a bounded sample of documents; all documents are scored on the executors, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

BITS = 18  #: hashed features
BEGINNINGS = (4, 5)  #: lengths of word beginnings
SAMPLE_ROWS = 12_000  #: labelled rows that training reads at most
LEAST_DOCUMENTS = 4  #: sampled documents that a feature occurs in at least
PART_ROWS = 1_000  #: rows that a step of training works on at a time; bounds the memory, not the result
MENTION_ROWS = 2_000  #: sampled rows that get a mention of a group at most

#: Groups of identity terms; a term is swapped for the others of its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
)
GROUP_OF = {term: group for group in IDENTITY_TERMS for term in group}
TOKEN = re.compile(r"\w+")


def hashed(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) & ((1 << BITS) - 1)


class Features(dict):
    """Features of a word, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        own = (hashed(word), *(hashed(f"{word[:n]}^") for n in BEGINNINGS if len(word) >= n))
        self[word] = own
        return own


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def features(words: list[str] | set[str], known: Features) -> set[int]:
    """Distinct features."""
    return {f for w in set(words) for f in known[w]}


def changes(words: list[str], own: set[int], known: Features, mention: bool) -> list[tuple[set[int], set[int]]]:
    """What each counterfactual of a labelled text gains and loses: swapped terms, and with ``mention`` each term added in turn."""
    there = [w for w in dict.fromkeys(words) if w in GROUP_OF]
    found = []
    for k in range(1, 1 + max((len(GROUP_OF[w]) - 1 for w in there), default=0)):
        swapped = {w: GROUP_OF[w][(GROUP_OF[w].index(w) + k) % len(GROUP_OF[w])] for w in there}
        new = features([swapped.get(w, w) for w in words], known)
        found.append((new - own, own - new))
    if mention:
        found += [(set(known[term]) - own, set()) for term in GROUP_OF if term not in there]
    return found


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margin(self, text: str | None) -> float:
        return WordMargins(self.weights).margin(text) + self.bias


def telling(found: list[np.ndarray], y: np.ndarray, least: int, spread: float) -> np.ndarray:
    """Which features occur in ``least`` documents or more, and in the labels' documents at shares that differ by ``spread`` standard errors."""
    size = 1 << BITS
    yes, no = np.zeros(size), np.zeros(size)
    for f, label in zip(found, y, strict=True):  # features of a text are distinct
        (yes if label else no)[f] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    share = (yes + no) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return (yes + no >= least) & (np.abs(yes / n1 - no / n0) >= spread * error)


def swaps(text: str | None, known: Features) -> list[tuple[set[int], set[int]]]:
    """What each swap of a text's identity terms gains and loses."""
    words = words_of(text)
    return [] if GROUP_OF.keys().isdisjoint(words) else changes(words, features(words, known), known, False)


def train(texts: list[str | None], toxic: list[int], **options) -> Model:
    """``train_on`` the features of ``texts``, taken here."""
    known = Features()
    rows = [(np.array([*features(words_of(t), known)], np.int32), [(sorted(a), sorted(b)) for a, b in swaps(t, known)]) for t in texts]
    return train_on([f for f, _ in rows], [s for _, s in rows], toxic, **options)


def train_on(
    found: list[np.ndarray], swapped: list[list[tuple]], toxic: list[int], *, penalty: float = 1.0, ridge: float = 1e-4, steps: int = 300, least: int = LEAST_DOCUMENTS, spread: float = 2.5, mentions: int = MENTION_ROWS
) -> Model:
    """Fit by Adam on the whole sample: each text's features, what its swaps gain and lose, and its label.

    ``penalty`` weighs the mean squared score change over counterfactual pairs; 0 leaves them out. Features that ``telling`` leaves out
    get no weight. Both labels weigh alike. Without rows of both labels the model gives the share of label 1 (a half for no rows) to
    every text.
    """
    known, y = Features(), np.array(toxic, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else min(max(y.mean(), 0.01), 0.99)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    used = telling(found, y, least, spread)
    every, pairs = max(1, len(found) // mentions), []
    for i in range(len(found) if penalty else 0):
        gained = [(a, b) for a, b in swapped[i]]
        if i % every == 0:
            own = {*found[i].tolist()}
            gained += [([f for f in known[t] if f not in own], []) for t in GROUP_OF if known[t][0] not in own]
        pairs += [p for p in (([f for f in gain if used[f]], [f for f in loss if used[f]]) for gain, loss in gained) if p[0] or p[1]]
    compact = (np.cumsum(used) - 1).astype(np.int32)  # features that may get weight, numbered
    size = int(used.sum())
    parts = []  # of rows at a time: their features, and how many each has
    for k in range(0, len(found), PART_ROWS):
        kept = [compact[f[used[f]]] for f in found[k : k + PART_ROWS]]
        parts.append((k, np.concatenate(kept), np.array([*map(len, kept)])))
    del found, swapped, kept  # what may get weight is held, and no more
    n_pairs, changed = len(pairs), np.array([len(a) + len(b) for a, b in pairs], np.int64)
    moved = compact[np.fromiter((f for a, b in pairs for f in (*a, *b)), np.int64, int(changed.sum()))]
    sign = np.fromiter((x for a, b in pairs for x in (*[1.0] * len(a), *[-1.0] * len(b))), np.float32, len(moved))
    pair = np.repeat(np.arange(n_pairs, dtype=np.int32), changed)
    del pairs
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        g, gb = ridge * w, 0.0
        for k, columns, n in parts:
            own = slice(k, k + len(n))
            row = np.repeat(np.arange(len(n)), n)
            z = np.bincount(row, weights=w[columns], minlength=len(n)) + b
            residual = weight[own] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own])
            g += np.bincount(columns, weights=residual[row], minlength=size)
            gb += residual.sum()
        if len(moved):
            change = np.bincount(pair, weights=sign * w[moved], minlength=n_pairs)
            g += 2 * penalty / n_pairs * np.bincount(moved, weights=sign * change[pair], minlength=size)
        rate = 0.1 / (1 + step / 50)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, seed: int = 3) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of at most ``rows`` labelled documents, those of the smallest hashes; none whose ``crc32(doc_id) mod 5`` is 0.

    Half the rows at most are of either label. Labels that are null, or of documents that aren't there, are left out; of several labels
    of a document the largest counts, and of several texts of an id the smallest.
    """
    seen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    seen = seen.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = [seen.filter(F.col("toxic") == k).groupBy("doc_id", "toxic").count().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows // 2) for k in (0, 1)]
    ids = chosen[0].union(chosen[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # ``rows`` ids


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Train on the sample, in one task: its rows are bounded by ``SAMPLE_ROWS``. The driver gets the weights alone."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Features()
        packed = lambda s: np.array(sorted(s), "<i4").tobytes()
        for batch in batches:
            own = [packed(features(words_of(t), known)) for t in batch.text]
            moved = [swaps(t, known) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "toxic": batch.toxic, "found": own, "gains": [[packed(a) for a, _ in m] for m in moved], "losses": [[packed(b) for _, b in m] for m in moved]})

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda b: np.frombuffer(bytes(b), "<i4")
        rows = [r for batch in batches for r in batch.itertuples(index=False, name=None)]
        rows.sort(key=lambda r: r[0], reverse=True)
        found, swapped, toxic = [], [], []
        while rows:
            _, label, own, gains, losses = rows.pop()
            found.append(read(own))
            swapped.append([(read(a).tolist(), read(b).tolist()) for a, b in zip(gains, losses, strict=True)])
            toxic.append(label)
        model = train_on(found, swapped, toxic, **options)
        yield pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias]})

    rows = labelled_sample(docs, labels).mapInPandas(run, "doc_id long, toxic int, found binary, gains array<binary>, losses array<binary>")
    model = rows.repartition(1).mapInPandas(trained, "weights binary, bias double").collect()  # a row of a megabyte, or none where no task ran
    return Model(np.frombuffer(bytes(model[0].weights), "<f4"), model[0].bias) if model else train_on([], [], [], **options)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` for each row; with ``keep``, all columns of ``docs`` and ``toxicity_score``.

    Null and empty texts get the score of no features. Equal texts, so also repeated rows, have equal scores. An empty table gives no
    rows. Words are remembered within a task only, and a bounded number of them.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 2**BITS floats

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        known = WordMargins(weights)
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(known.margin(t) + bias, -30, 30))) for t in texts], dtype="float64")

    if keep:
        return docs.withColumn("toxicity_score", scored(F.col(text_col)))
    got = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col)).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


class WordMargins(dict):
    """The features of a word that carry weight, remembered for a bounded number of words; most words have none."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.features = weights, Features()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        own = tuple(f for f in self.features[word] if self.weights[f] != 0)
        self.features.clear()
        self[word] = own
        return own

    def margin(self, text: str | None) -> float:
        found = {f for w in set(words_of(text)) for f in self[w]}
        return float(self.weights[sorted(found)].sum(dtype=np.float64)) if found else 0.0
