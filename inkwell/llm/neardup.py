"""Near-duplicate documents by MinHash bands, verified by odd sketches and confirmed on full shingle sets.

One pass over the texts gives each document its set's size and 128-bit key, a band key for every ``rows`` MinHash samples, and an odd
sketch: the samples folded into a parity bitmap. The symmetric difference of two sample sets is about ``-n/2 ln(1 - 2z/n)`` for ``z``
differing bits of ``n``, which tells similarities near the threshold apart far better than a count of equal bands. After that:

1. Documents of equal sets form a class; its smallest id stands for it. Copies take no further part.
2. Classes that share a band key share a bucket; of buckets with the same members one is kept. Every member is compared by sketch with its
   buckets' smallest members (as many pairs as rows); each member's closest two are confirmed on full sets, and links are joined into
   components.
3. What is left are buckets that hold several components. In a few rounds each member outside its buckets' largest components is
   compared with one member of each of those, which again makes a pair for each row at most, and the closest two are confirmed.
4. At last each member that is still outside meets the members of its buckets' other components, in blocks. A block's task has sketches
   and texts: pairs within the sketch's margin are confirmed there and joined at once, and only the links that join two components
   leave it. So every pair of a bucket is in one component or has been tested, and a block gives fewer links than it has rows, however
   alike its rows are.

A pair at the threshold shares no bucket with probability ``(1 - t**rows)**bands`` (5e-7 by default) and fails the sketch's margin of
five standard deviations with probability 3e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, bounded_batches, slices

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
ROUNDS = 3  #: rounds of partners before all that is left meets in blocks; they change the work, not the result
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20  #: rows and shingles of a block, about
FEW = 8  #: pairs of a row that are confirmed one by one; more are counted through the block's postings
DEVIATIONS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX_B
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased; a text of fewer words is one shingle, no word none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = mixed(s * MIX_A + h[j : len(h) - k + 1 + j])
    return np.unique(s)


class Sampler:
    """``n`` MinHash samples of a set, and what is made of them."""

    def __init__(self, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.tag = mixed(np.arange(1, n + 1, dtype=np.uint64) * MIX_A)
        self.width = max(64, (1 << 19) // n)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), self.width):  # bounds memory for long texts
            part = x[at : at + self.width][None, :] * self.a
            part += self.b
            part = part.min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return low.astype(np.uint64)

    def sketch(self, samples: np.ndarray, bits: int) -> np.ndarray:
        """Parity bitmap of the numbered samples."""
        at = (mixed(samples * MIX_A + self.tag) % np.uint64(bits)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64) * MIX_B)
    for column in samples.reshape(bands, -1).T:
        key = mixed(key * MIX_A + column)
    return key.view(np.int64)


def most_differing_bits(samples: int, bits: int, similarity: float) -> int:
    """Differing sketch bits that a pair of ``similarity`` shows at most, but for ``DEVIATIONS`` standard deviations of samples and fold together."""
    apart = 2 * samples * (1 - similarity)
    of_samples = 2 * math.sqrt(samples * similarity * (1 - similarity))
    slope = math.exp(-2 * apart / bits)
    of_fold = math.sqrt(bits / 4 * (1 - math.exp(-4 * apart / bits)))
    return math.ceil(bits / 2 * (1 - slope) + DEVIATIONS * math.hypot(of_samples * slope, of_fold))


def signatures(docs: DataFrame, *, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``: set size, set key (null for no words), band keys and sketch words ``s0``..."""
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), *((f"s{i}", pa.int64()) for i in range(SKETCH_WORDS))]
    schema = pa.schema(fields)
    ddl = ", ".join(f"{n} {'array<long>' if n == 'bands' else 'long'}" for n, _ in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows, seed)
        for batch in batches:
            for part in slices(batch, 1):
                size, key, band, sketch = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    size.append(len(s))
                    if len(s):
                        d = xxhash.xxh3_128_digest(s.tobytes())
                        m = sampler.samples(s)
                        key.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
                        band.append(band_keys(m, bands))
                        sketch.append(sampler.sketch(m, SKETCH_BITS))
                    else:
                        key.append((None, None))
                        band.append(np.empty(0, np.int64))
                        sketch.append(np.zeros(SKETCH_WORDS, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in band])]).astype(np.int32)
                columns = [part.column(0), pa.array(size, pa.int64()), pa.array([a for a, _ in key], pa.int64()), pa.array([b for _, b in key], pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(band))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in np.ascontiguousarray(np.array(sketch).T))], schema=schema)

    return docs.mapInArrow(run, ddl)


def differing_bits(a: str, b: str):
    return F.expr(" + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(SKETCH_WORDS)))


def id_filter(ids: DataFrame, n: int) -> Column:
    """A predicate on ``doc_id`` that is true for all of the ``n`` ``ids`` and false for most others: a bitmap of 16 bits an id, 2 MB at most."""
    size = 1 << min(24, max(10, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(size))
    words = ids.select(place.alias("p")).groupBy(F.expr("p div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("bits"))
    bitmap = np.zeros(size // 32, np.uint32)
    found = words.toArrow()  # in one job: a row of 16 bytes for each word of the bitmap at most
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return maybe(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(size)))


def linked(common, n, m, percent: int):
    """Whether sets of ``n`` and ``m`` shingles, ``common`` of them shared, are as alike as that."""
    return 100 * common >= percent * (n + m - common)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, 2):
                keep = []
                for a, b, ta, tb in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if size > 1 << 20:
                        held.clear()
                        size = 0
                    for i, t in ((a, ta), (b, tb)):
                        if i not in held:
                            held[i] = shingle_set(t, words)
                            size += len(held[i])
                    x, y = held[a], held[b]
                    keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    t = texts.select(F.col("doc_id").alias("id"), "text")
    both = pairs.join(t.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(t.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, own: Scratch | None = None) -> DataFrame:
    """``id`` and ``component`` (the smallest id it reaches) for each id of ``links(a, b)`` that is not its component's smallest.

    Large-star and small-star steps in turn until nothing changes: edges ``x > y`` move to the smallest neighbour of ``y``, then those of
    an ``x`` to the smallest of its own. Minima are aggregated before the shuffle; those that a hub's edges meet are kept as a table, so that
    this is a plain join whose large partitions Spark can split. Each round's edges are written; only a count and a checksum come to the driver.
    """
    own, before = own or Scratch(links.sparkSession), None
    e = links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct()
    while True:
        e = own.staged(e, "links", light=True)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(x, y))").alias("sum")).first()
        if now.n == 0 or now == before:
            return e.select(F.col("x").alias("id"), F.col("y").alias("component"))
        before = now
        low = own.kept(e.groupBy("x").agg(F.min("y").alias("m")))
        large = e.join(low.select(F.col("x").alias("y"), F.col("m").alias("lower")), "y", "left").select("x", F.coalesce("lower", "y").alias("y"))
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        e = small.select("e.x", "e.y").filter("x <> y").distinct()


def joined(labels: DataFrame, links: DataFrame, own: Scratch) -> DataFrame:
    """``labels`` (of ``components``) after more ``links``: only the components that those join are worked on."""
    at = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    more = components(between, own)
    kept = labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    return own.staged(kept.select("id", F.coalesce("top", "component").alias("component")).union(more), "dup-labels", light=True)


def mixed_buckets(members: DataFrame, labels: DataFrame, own: Scratch) -> DataFrame:
    """``key``, ``id``, ``component`` and the bucket's ``largest`` component, of the buckets that hold several."""
    named = members.select("key", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = named.groupBy("key", "component").count().groupBy("key")
    largest = own.kept(counts.agg(F.expr("max_by(component, struct(count, -component))").alias("largest"), F.count(F.lit(1)).alias("several")).filter("several > 1").drop("several"))
    return own.kept(named.join(largest, "key"))


def round_of_partners(named: DataFrame, links: DataFrame, sketch: DataFrame, zmax: int, tested: DataFrame, n: int, own: Scratch) -> DataFrame:
    """New pairs to confirm: each member outside its buckets' largest components with the two closest of their partners.

    A bucket's partner is one member of its largest component: the one of most links in round 0, by hash after that. So a round makes a
    pair for each row at most, and what has links to a share of a group finds one within a few rounds.
    """
    inside = named.filter("component = largest")
    order = F.struct(F.xxhash64(F.lit(n), "key", "id"), "id")
    if n == 0:
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
        inside, order = inside.join(degree, "id", "left"), F.struct(-F.coalesce("count", F.lit(0)), "id")
    partners = own.kept(inside.groupBy("key").agg(F.min_by("id", order).alias("partner")))
    pairs = named.filter("component <> largest").join(partners, "key").select("id", "partner").distinct().alias("p")
    a, b = sketch.alias("a"), sketch.alias("b")
    pairs = pairs.join(a, F.col("p.id") == F.col("a.id")).join(b, F.col("p.partner") == F.col("b.id")).select("p.id", "p.partner", differing_bits("a", "b").alias("z")).filter(F.col("z") <= zmax)
    pairs = pairs.select("id", "z", F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).join(tested, ["a", "b"], "left_anti")
    return pairs.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("z", "a", "b"))).filter("n <= 2").select("a", "b").distinct()


class Postings:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.n, every = len(sets), np.concatenate(sets)
        self.sizes = np.array([*map(len, sets)])
        owner = np.repeat(np.arange(self.n), self.sizes)
        by = np.argsort(every, kind="stable")
        self.owner = owner[by]
        self.shingles, start = np.unique(every[by], return_index=True)
        self.start = np.append(start, len(every))

    def common(self, shingles: np.ndarray) -> np.ndarray:
        """How many of ``shingles`` each set holds."""
        at = np.searchsorted(self.shingles, shingles)
        at = at[(at < len(self.shingles)) & (self.shingles[np.minimum(at, len(self.shingles) - 1)] == shingles)]
        found = [self.owner[self.start[k] : self.start[k + 1]] for k in at]
        return np.bincount(np.concatenate(found), minlength=self.n) if found else np.zeros(self.n, np.int64)


@dataclass
class Block:
    """Rows that meet. Those that ``ask`` are compared with those that are ``asked``; ``inside`` is the bucket's largest component. Sets are made of texts when needed."""

    ids: np.ndarray
    component: np.ndarray
    inside: np.ndarray
    ask: np.ndarray
    asked: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    texts: list[str]

    def links(self, words: int, percent: int, zmax: int) -> list[tuple[int, int]]:
        """Confirmed links that join two components each; of two rows outside the largest the smaller id asks."""
        found, postings, sets = [], None, {}

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(self.texts[k], words)
            return sets[k]

        label = np.unique(self.component, return_inverse=True)[1]
        y = np.flatnonzero(self.asked)
        bits, m, ids, inside = self.bits[y], self.n[y], self.ids[y], self.inside[y]
        for i in np.flatnonzero(self.ask):
            n = self.n[i]
            c = np.flatnonzero((label[y] != label[i]) & (inside | (ids > self.ids[i])) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n)))
            c = c[np.bitwise_count(bits[c] ^ self.bits[i]).sum(axis=1, dtype=np.int64) <= zmax]
            sure = len(c) > FEW
            if sure:
                postings = postings or Postings([set_of(k) for k in y])
                c = c[linked(postings.common(set_of(i))[c], len(set_of(i)), postings.sizes[c], percent)]
            for j in y[c]:
                if label[j] != label[i] and (sure or linked(len(np.intersect1d(set_of(i), set_of(j), assume_unique=True)), len(set_of(i)), len(set_of(j)), percent)):
                    found.append((int(min(self.ids[i], self.ids[j])), int(max(self.ids[i], self.ids[j]))))
                    label[label == label[j]] = label[i]
        return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of rows ``key, bx, by, role, id, component, inside, n, text, s0``... that come in order of the first three."""
    held = None
    for batch in batches:
        numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
        bits = np.stack([batch.column(9 + i).to_numpy() for i in range(SKETCH_WORDS)], 1).view(np.uint64)
        rows = (*numbers, bits, batch.column(8).to_pylist())
        if held is not None:
            rows = (*(np.concatenate([h, r]) for h, r in zip(held[:9], rows[:9], strict=True)), held[9] + rows[9])
        key, bx, by = rows[:3]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])) + 1
        starts = [0, *cut.tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield block_of(rows, a, b)
        held = tuple(r[starts[-1] :] for r in rows)
    if held is not None and len(held[0]):
        yield block_of(held, 0, len(held[0]))


def block_of(rows: tuple, a: int, b: int) -> Block:
    _, _, _, role, ids, component, inside, n, bits, texts = (r[a:b] for r in rows)
    return Block(ids, component, inside.astype(bool), (role & 1) > 0, (role & 2) > 0, n, bits, texts)


def block_links(named: DataFrame, sketch: DataFrame, texts: DataFrame, words: int, percent: int, zmax: int, own: Scratch) -> DataFrame:
    """Links ``a``, ``b`` between components of a bucket, of all pairs that neither are in one component nor both in the largest.

    A bucket's outside members and all its members are dealt by hash into blocks of about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles,
    and each two blocks meet in one place; a bucket that fits into one block is sent once. Rows carry sketch and text.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            if found := block.links(words, percent, zmax):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    outside = F.col("component") != F.col("largest")
    size = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = named.join(sketch.select("id", "n"), "id").groupBy("key")
    sizes = sizes.agg(size(F.count_if(outside), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0))).alias("nx"), size(F.count(F.lit(1)), F.sum("n")).alias("ny"))
    rows = named.join(own.kept(sizes), "key").withColumn("outside", outside.cast("int"))
    whole = "array(struct(0 as bx, 0 as by, 2 + outside as role))"
    asks = "transform(sequence(0, ny - 1), k -> struct(cast(pmod(xxhash64(id), nx) as int) as bx, k as by, 1 as role))"
    asked = "transform(sequence(0, nx - 1), k -> struct(k as bx, cast(pmod(xxhash64(id), ny) as int) as by, 2 as role))"
    places = F.expr(f"CASE WHEN ny = 1 THEN {whole} WHEN outside = 1 THEN concat({asks}, {asked}) ELSE {asked} END")
    rows = rows.select("key", "id", "component", (1 - F.col("outside")).alias("inside"), F.inline(places))
    rows = rows.join(sketch.join(texts.withColumnRenamed("doc_id", "id"), "id"), "id")
    rows = rows.select("key", "bx", "by", "role", "id", "component", "inside", "n", "text", *(f"s{i}" for i in range(SKETCH_WORDS)))
    return rows.repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by").mapInArrow(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 48,
    rows: int = 6,
    seed: int = 7,
) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id linked to it, directly or not) and ``kept``.

    Documents are linked if their sets of distinct ``words``-word shingles (A-Z lower-cased, words by ASCII white space) have
    ``100 * intersection >= percent * union``. A text with fewer words is one shingle. Null texts and texts without words have no
    shingle and are linked with nothing. Rows without id are linked with nothing and kept. Equal rows are copies of one another and
    share its id, so all of them are kept. Rows that share an id but not a text are joined to their own texts' copies, and beyond those the
    id is linked by its smallest text. An empty table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = Scratch(docs.sparkSession)
    staged = own.staged
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = staged(signatures(docs, words=words, bands=bands, rows=rows, seed=seed), "dup-signatures")
    sets = sig.filter("doc_id is not null and k1 is not null")
    classes = staged(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "dup-classes", light=True)
    first = sets.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").withColumnRenamed("doc_id", "id")
    first = staged(first.select("id", F.col("n_shingles").alias("n"), "bands", *(f"s{i}" for i in range(SKETCH_WORDS))), "dup-first", light=True)
    sketch = first.drop("bands")

    keyed = first.select("id", F.explode("bands").alias("key"))
    who = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"who{k}") for k in (0, 1)]
    shared = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("n"), *who).filter("hub < top")
    shared = own.kept(shared.groupBy("hub", "n", "who0", "who1").agg(F.min("key").alias("key")).select("key", "hub"))
    members = staged(keyed.join(shared, "key"), "dup-members", light=True)

    zmax = most_differing_bits(bands * rows, SKETCH_BITS, percent / 100)
    a, b = sketch.alias("a"), sketch.alias("b")
    stars = members.filter("id <> hub").select("id", "hub").distinct().alias("p")
    stars = stars.join(a, F.col("p.id") == F.col("a.id")).join(b, F.col("p.hub") == F.col("b.id"))
    stars = stars.select("p.hub", "p.id", differing_bits("a", "b").alias("z")).filter(F.col("z") <= zmax)
    closest = stars.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("z", "hub"))).filter("n <= 2")
    tested = own.kept(closest.select(F.col("hub").alias("a"), F.col("id").alias("b")))

    ids = own.kept(members.select("id").distinct())
    texts = docs.filter("doc_id is not null").filter(id_filter(ids, ids.count()))
    texts = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = staged(texts, "dup-texts")
    links, left = staged(confirmed(tested, texts, words, percent), "dup-links", light=True), None
    labels = staged(components(links, own), "dup-labels", light=True)
    for n in range(ROUNDS + 1):
        named = mixed_buckets(members, labels, own)
        before, left = left, named.count()
        if left == 0 or n == ROUNDS or (before is not None and left > 0.9 * before):
            break
        pairs = own.kept(round_of_partners(named, links, sketch, zmax, tested, n, own))
        more = staged(confirmed(pairs, texts, words, percent), "dup-links", light=True)
        tested, links, labels = tested.union(pairs), links.union(more), joined(labels, more, own)

    if left:
        labels = joined(labels, staged(block_links(named, sketch, texts, words, percent, zmax, own), "dup-links", light=True), own)
    own.drop(sig, classes, labels)

    copies = classes.filter("n > 1").select("k1", "k2", F.col("id").alias("copy_of"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(copies, ["k1", "k2"], "left").withColumn("at", F.coalesce("copy_of", "doc_id"))
    out = out.join(labels.withColumnRenamed("id", "at"), "at", "left").withColumn("component_id", F.coalesce("component", "at"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
