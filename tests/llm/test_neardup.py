"""Near duplicates against brute force over all pairs."""

import random

import pytest

from inkwell.llm import neardup

SCHEMA = "doc_id long, text string, key string"


def brute(rows, words):
    """Size, smallest linked id and kept flag by comparing every pair."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    at = [*range(len(rows))]

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and None not in (rows[i][0], rows[j][0]) and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                at[max(top(i), top(j), key=lambda k: rows[k][0])] = min(top(i), top(j), key=lambda k: rows[k][0])
    return sorted((i or -1, len(s), rows[top(k)][0] if i is not None else -1) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def changed(r, words, share):
    return [f"n{r.randrange(10**6)}" if r.random() < share else w for w in words]


def corpus(seed, groups, copies, length):
    r, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(length)]
        rows += [" ".join(changed(r, base, r.choice([0, 0.01, 0.03, 0.05, 0.08, 0.12]))) for _ in range(copies)]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = neardup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted((-1 if r.doc_id is None else (r.doc_id or -1), r.n_shingles, -1 if r.doc_id is None else r.component_id) for r in got)


def test_groups(spark):
    texts = corpus(1, 12, 9, 120)
    random.Random(2).shuffle(texts)
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    assert run(spark, rows, words=2) == brute(rows, 2)


def test_big_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "FEW", 2)
    rows = [(k + 1, t) for k, t in enumerate(corpus(3, 1, 90, 150))]
    assert run(spark, rows, words=2) == brute(rows, 2)


def test_links_stay_in_proportion_to_a_group(spark, monkeypatch):
    """Copies that share buckets and are seldom linked: what leaves the blocks must not grow as pairs do."""
    made = []
    plain = neardup.block_links

    def counted(*a):
        made.append(plain(*a).count())
        return plain(*a)

    monkeypatch.setattr(neardup, "block_links", counted)
    monkeypatch.setattr(neardup, "BLOCK", 128)
    r = random.Random(9)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    for n in (250, 500):
        rows = [(k + 1, " ".join(changed(r, base, 0.05))) for k in range(n)]
        made.clear()
        assert run(spark, rows, words=2) == brute(rows, 2)
        assert 0 < sum(made) < 5 * n


def test_block():
    import numpy as np

    r = random.Random(4)
    sampler, limit = neardup.Sampler(288, 7), neardup.most_differing_bits(288, 1024, 0.8)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(changed(r, base, r.choice([0, 0.02, 0.05, 0.1]))) for _ in range(60)]
    sets = [neardup.shingle_set(t, 2) for t in texts]
    n, every = len(sets), np.ones(60, bool)
    bits = np.stack([sampler.sketch(sampler.samples(s), 1024).view(np.uint64) for s in sets])
    at = list(range(n))
    for i in range(n):
        for j in range(i):
            if neardup.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80):
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    links = neardup.Block(np.arange(n), np.arange(n), ~every, every, every, np.array([*map(len, sets)]), bits, texts).links(2, 80, limit)
    got = list(range(n))
    for a, b in links:
        a, b = got[a], got[b]
        assert a != b
        got = [min(a, b) if x in (a, b) else x for x in got]
    assert got == at and len(set(at)) < n


def test_components(spark):
    r = random.Random(5)
    for edges in ([(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 60), (60, 55)], [(r.randrange(80), r.randrange(80)) for _ in range(60)], []):
        at = list(range(100))
        for a, b in edges:
            a, b = at[a], at[b]
            at = [min(a, b) if x in (a, b) else x for x in at]
        got = {x.id: x.component for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: c for k, c in enumerate(at) if k != c}


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, b), (2, a), (2, b), (3, a + " x"), (4, b + " x"), (5, a)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted((x.doc_id, x.component_id) for x in neardup.near_duplicates(df, words=2).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 1), (5, 2)]


def test_id_filter_takes_one_job_for_all_partitions(spark):
    ids = spark.range(0, 4000, 2).withColumnRenamed("id", "n").selectExpr("n * 7919 as id")
    spark.sparkContext.setJobGroup("bitmap", "id_filter")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        maybe = neardup.id_filter(ids, 2000)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4
    assert ids.withColumnRenamed("id", "doc_id").filter(maybe).count() == 2000
    assert spark.range(10**6, 10**6 + 4000).withColumnRenamed("id", "doc_id").filter(maybe).count() < 800
    none = neardup.id_filter(ids.limit(0), 0)
    assert ids.withColumnRenamed("id", "doc_id").filter(none).count() == 0


def test_edges(spark):
    long = " ".join(f"v{k % 5000}x{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tB"), (8, long), (9, long + " z"), (10, "É é"), (11, "é é"), (None, "a b"), (6, "a b")]
    assert run(spark, rows, words=2) == brute(rows, 2)


def test_empty(spark):
    assert run(spark, [], words=2) == []


def test_five_words_by_default(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b c d e f g h i j")]
    assert run(spark, rows) == brute(rows, 5)


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_sketch_margin(similarity):
    import numpy as np

    sampler, r, over = neardup.Sampler(288, 1), np.random.default_rng(0), 0
    limit = neardup.most_differing_bits(288, 1024, similarity)
    for _ in range(200):
        common = r.integers(0, 1 << 63, int(1000 * similarity), dtype=np.uint64)
        rest = r.integers(0, 1 << 63, (2, (1000 - len(common)) // 2), dtype=np.uint64)
        a, b = (sampler.sketch(sampler.samples(np.concatenate([common, x])), 1024) for x in rest)
        over += int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) > limit
    assert over == 0
