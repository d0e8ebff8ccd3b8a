"""Index tables and search: the two-document example, edge cases and invariants."""

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkwell import repl
from inkwell.functions import scoring
from inkwell.operators import index
from inkwell.operators.search import Engine, missing_ids, run_lines
from inkwell.plans import catalogue
from inkwell.sources import files
from inkwell.streaming import incremental

TINY = [(0, "This is a test document."), (1, "Another test here.")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over(spark.createDataFrame(TINY, SCHEMA))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_example(engine):
    for mode in "cd":
        assert rows_of(engine.search("test", mode).orderBy("rank")) == [(1, 1, 0.205433), (2, 0, 0.163885)]
    assert rows_of(engine.search("test zzz", "c")) == [] and engine.missing("test zzz") == ["zzz"]
    assert rows_of(engine.search("test zzz", "d").orderBy("rank")) == [(1, 1, 0.205433), (2, 0, 0.163885)]
    assert [r.score for r in engine.search("test test").orderBy("rank").collect()] == pytest.approx([2 * 0.205433, 2 * 0.163885], abs=2e-6)
    assert rows_of(engine.search("!!!")) == [] and rows_of(engine.search("")) == []
    with pytest.raises(ValueError):
        engine.search("test", "x")
    words = index.word_ids(engine.index.lexicon).orderBy("word_id").collect()
    assert [(r.term, r.word_id) for r in words] == list(zip("a another document here is test this".split(), range(7), strict=True))
    assert (engine.index.n_docs, engine.index.avgdl, engine.index.total_words, engine.index.max_doc_id) == (2, 4.0, 8, 1)


def test_batch_and_snippets(spark, engine):
    queries = spark.createDataFrame([(1, "test"), (2, "another zzz"), (3, "")], "query_id int, query string")
    wanted = spark.createDataFrame([(1,), (2,), (2,), (9,)], "query_id int")
    assert rows_of(engine.search_batch(queries, "c", 1, wanted).orderBy("query_id")) == [(1, 1, 1, 0.205433)]
    assert {r.query_id for r in engine.search_batch(queries, "d", 5).collect()} == {1, 2}
    assert rows_of(missing_ids(queries, wanted)) == [(9,)]
    assert {r.snippet for r in engine.with_snippets(engine.search("test")).collect()} == {t for _, t in TINY}
    assert rows_of(run_lines(engine.search_batch(queries, "c", 1))) == [("1\t1\t0.205433",)]


def test_scores_of_result_lines(spark, sf, monkeypatch):
    scores = [252.049832, 1151.349999, 115.05, 0.000001, 12.0, 1234567.049999]
    results = spark.createDataFrame([(1, k, k, x) for k, x in enumerate(scores)], "query_id int, rank long, doc_id long, score double")
    assert [r.line.split("\t")[2] for r in run_lines(results).orderBy("line").collect()] == ["252.05", "1151.35", "115.05", "1e-06", "12", "1.23457e+06"]
    assert [float(r.line.split("\t")[2]) for r in run_lines(results, scoring.EXACT).orderBy("line").collect()] == scores
    monkeypatch.setattr(catalogue, "engine", lambda s, d: SimpleNamespace(search_batch=lambda *a: results))
    got = catalogue.queries()["result_tsv"](spark, sf).orderBy("doc_id").collect()
    assert [r.score for r in got] == [252.0, 1151.3, 115.1, 0.0, 12.0, 1234567.0]


def test_sizes_of_large_ids(spark, sf, monkeypatch):
    """The SQL of varbyte_len has five bytes at most, whatever the number."""
    posted = spark.createDataFrame([("a", 11, 1), ("a", 20_000, 1), ("a", 200_000, 1), ("b", 200_000, 1), ("b", 3_000_000, 9)], "term string, doc_id long, tf long")
    monkeypatch.setattr(catalogue, "engine", lambda s, d: SimpleNamespace(index=SimpleNamespace(postings=posted)))
    assert rows_of(catalogue.queries()["varbyte_len"](spark, sf).orderBy("n")) == [(121, 1), (400_000_000, 5), (40_000_000_000, 5), (81_000_000_000_000, 5)]


def test_empty_and_null(spark):
    e = Engine.over(spark.createDataFrame([], SCHEMA))
    assert rows_of(e.search("x")) == [] and e.index.n_docs == 0
    e = Engine.over(spark.createDataFrame([(1, None), (None, "x"), (2, "x"), (3, "")], SCHEMA))
    assert e.index.n_docs == 3 and [r.doc_id for r in e.search("x").collect()] == [2]
    with pytest.raises(ValueError):
        Engine.over(spark.createDataFrame([(1, "a"), (1, "b")], SCHEMA))


def bm25(docs, query, mode, k):
    """The model: plain loops."""
    bags = {i: Counter(re.findall("[a-z0-9]+", t.lower())) for i, t in docs}
    df, asked = Counter(w for b in bags.values() for w in b), Counter(re.findall("[a-z0-9]+", query.lower()))
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    found = []
    for i, b in bags.items():
        hits = [w for w in asked if w in b]
        if hits and (mode == "d" or len(hits) == len(asked)):
            s = sum(asked[w] * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for w in hits)
            found.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


def test_against_model(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(r.randint(1, 12)))) for i in range(60)]
    e = Engine.over(spark.createDataFrame(docs, SCHEMA))
    queries = [(q, " ".join(r.choice("ab cd ef gh zz".split()) for _ in range(r.randint(1, 4)))) for q in range(12)]
    for mode in "cd":
        got = defaultdict(list)
        for x in e.search_batch(spark.createDataFrame(queries, "query_id int, query string"), mode, 5).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.doc_id, x.score))
        for q, text in queries:
            want = bm25(docs, text, mode, 5)
            assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("n", [127, 128, 129, 256, 257])
def test_blocks(spark, n):
    posted = spark.range(n).select(F.lit("t").alias("term"), (F.col("id") * 3 + 5).alias("doc_id"), F.lit(1).cast("long").alias("tf"))
    encoded = index.gaps(posted)
    blocks = index.posting_blocks(encoded).orderBy("block").collect()
    assert [b.n for b in blocks] == [min(128, n - k) for k in range(0, n, 128)] and blocks[-1].last_doc_id == 3 * (n - 1) + 5
    assert {r.doc_id for r in index.decode_gaps(encoded).collect()} == {3 * k + 5 for k in range(n)}


def test_segments(spark, tmp_path):
    ids = [*range(0, 400_000, 50_000), 7, 9_000_000_000]
    posted = spark.createDataFrame([(t, i, i % 5 + 1) for t in "ab" for i in ids if t == "a" or i < 8], "term string, doc_id long, tf long")
    rows = index.by_word(posted, segment=3).orderBy("term", "segment").collect()
    assert [(r.term, r.segment) for r in rows] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    assert [(p.doc_id, p.tf) for r in rows if r.term == "a" for p in r.postings] == [(i, i % 5 + 1) for i in sorted(ids)]
    assert all(len(r.postings) < 3 + 3 for r in rows) and index.by_word(posted).count() == 2
    assert index.by_word(posted.limit(0)).count() == 0
    runs = posted.replace({"a": "1", "b": "2"}, subset="term").select(F.col("term").cast("long").alias("word_id"), "doc_id", "tf")
    files.write_runs(runs, str(tmp_path / "runs"))
    assert sorted(rows_of(files.read_runs(spark, str(tmp_path / "runs")))) == sorted(rows_of(runs))
    lines = spark.createDataFrame([("1: 0 1 7 3",), ("1: 50000 1",)], "value string")  # a word that goes on in a further line
    assert sorted(rows_of(files.parse_runs(lines))) == [(1, 0, 1), (1, 7, 3), (1, 50000, 1)]


def test_long_line_of_a_run(spark):
    """A frequent word's line; more pairs than a stack has frames for."""
    pairs = " ".join(f"{i} {i % 3 + 1}" for i in range(200_000))
    lines = spark.createDataFrame([(f"7: {pairs}",), (f"8: {pairs} 5",), ("9: 1 2 \t",), ("9: 12",), ("9:",)], "value string")
    found = files.parse_runs(lines).groupBy("word_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("d"), F.sum("tf").alias("t"))
    assert sorted(rows_of(found)) == [(7, 200_000, sum(range(200_000)), sum(i % 3 + 1 for i in range(200_000))), (9, 1, 1, 2)]


def test_runs_of_a_frequent_word(spark, tmp_path):
    posted = spark.range(60_000).selectExpr("id % 5 div 4 as word_id", "id * 3 as doc_id", "id % 7 + 1 as tf")
    files.write_runs(posted, str(tmp_path / "runs"))
    found = files.read_runs(spark, str(tmp_path / "runs"))
    assert found.count() == 60_000 and found.exceptAll(posted).count() == 0
    assert spark.read.text(str(tmp_path / "runs")).count() == 2
    lines = spark.createDataFrame([("5:\t1 2\t 3  4 \t",), ("6: 1\t2",)], "value string")  # tabs are spaces too
    assert sorted(rows_of(files.parse_runs(lines))) == [(5, 1, 2), (5, 3, 4), (6, 1, 2)]


def test_search_reads_no_page_table(spark):
    e = Engine.over(spark.createDataFrame([(1, "a b"), (2, "a")], SCHEMA))
    assert e.index.postings.columns == ["term", "doc_id", "tf"]
    plan = e.search("a b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "num_words" in plan


def test_next_geq_and_chunks(spark):
    posted = spark.createDataFrame([("a", 3, 1), ("a", 9, 1)], "term string, doc_id long, tf long")
    probes = spark.createDataFrame([("a", 4), ("a", 9), ("a", 10), ("b", 0)], "term string, target long")
    assert {(r.term, r.target): r.doc_id for r in index.next_geq(posted, probes).collect()} == {("a", 4): 9, ("a", 9): 9, ("a", 10): None, ("b", 0): None}
    lines = spark.createDataFrame([(1, 1, "a b"), (2, 2, "a"), (3, 3, "")], "line_no long, doc_id long, text string")
    runs = index.chunk_postings(lines, 1)
    assert {r.chunk_id for r in runs.collect()} == {0, 1} and index.merge_chunks(runs).count() == 3
    with pytest.raises(ValueError):
        index.chunk_postings(lines, 0)


def test_encoded_blocks(spark, tmp_path):
    r = random.Random(2)
    posted = [(t, d, r.randint(1, 300)) for t, n in (("a", 300), ("b", 128), ("c", 1)) for d in sorted(r.sample(range(10**6), n))]
    frame = spark.createDataFrame(posted, "term string, doc_id long, tf long")
    for c in ("continue", "stop"):
        index.write_blocks(index.encode_blocks(frame, convention=c), str(tmp_path / c))
        blocks = index.read_blocks(spark, str(tmp_path / c))
        assert blocks.count() == 5 and sorted(rows_of(index.decode_blocks(blocks, c))) == sorted(posted)
        probes = [(t, x) for t in "abcz" for x in (0, *r.sample(range(10**6), 6), 10**7)] + [(t, d + e) for t, d, _ in r.sample(posted, 20) for e in (0, 1)]
        asked = spark.createDataFrame(probes, "term string, target long")
        got = {(x.term, x.target): x.doc_id for x in index.next_geq_of_blocks(blocks, asked, c).collect()}
        assert got == {(t, x): min((d for u, d, _ in posted if u == t and d >= x), default=None) for t, x in probes}
        assert {(x.term, x.target): x.doc_id for x in index.next_geq(frame, asked).collect()} == got


def test_files(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text('0\tThis is a "test" document.\nno tab\n12abc\tx\ty\njunk\tz\n7\tlast', newline="")
    docs = files.read_collection(spark, str(path)).orderBy("line_no").collect()
    assert [(d.line_no, d.doc_id, d.text) for d in docs] == [(1, 0, 'This is a "test" document.'), (3, 12, "x\ty"), (5, 7, "last")]
    assert {r.line_no for r in files.rejected(spark, str(path)).collect()} == {2, 4}
    files.write_collection(spark.createDataFrame([(1, "a\nb"), (2, None)], SCHEMA), str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in files.read_collection(spark, str(tmp_path / "out")).collect()} == {(1, "a b"), (2, "")}
    (tmp_path / "q.tsv").write_text("1\ta\n\n1\tb\nx\tc\n")
    assert rows_of(files.read_queries(spark, str(tmp_path / "q.tsv"))) == [(1, "b")]
    (tmp_path / "e.tsv").write_text("1\tx\n1\ty\n\n2\n")
    assert sorted(rows_of(files.read_evaluated(spark, str(tmp_path / "e.tsv")))) == [(1,), (2,)]
    posted = spark.createDataFrame([(0, 5, 2), (0, 3, 1), (1, 4, 7)], "word_id long, doc_id long, tf long")
    files.write_runs(posted.withColumn("chunk_id", F.lit(0)), str(tmp_path / "runs"))
    assert sorted(rows_of(files.read_runs(spark, str(tmp_path / "runs")))) == [(0, 3, 1), (0, 5, 2), (1, 4, 7)]
    files.write_word_ids(spark.createDataFrame([("a", 0), ("b", 1)], "term string, word_id long"), str(tmp_path / "w"))
    assert sorted(rows_of(files.read_word_ids(spark, str(tmp_path / "w")))) == [("a", 0), ("b", 1)]
    (tmp_path / "s.txt").write_text("http://b\r\n\r\nhttp://a\r\n")
    assert sorted(rows_of(files.read_seeds(spark, str(tmp_path / "s.txt")))) == [("http://a",), ("http://b",)]


def test_page_table_and_lexicon_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, 5, "ab c"), (2, 300, "é")], "line_no long, doc_id long, text string")
    extents = index.byte_extents(lines)
    assert {tuple(r) for r in extents.collect()} == {(5, 2, 4), (300, 11, 2)}
    pages = extents.join(index.page_table(lines), "doc_id")
    for c in ("continue", "stop"):
        coded = files.encode_page_table(pages, c)
        assert {tuple(r) for r in files.decode_page_table(coded, c).collect()} == {(5, 2, 4, 2), (300, 11, 2, 0)}
    (tmp_path / "p.bin").write_bytes(b"".join(bytes(r.data) for r in files.encode_page_table(pages).collect()))
    assert files.read_page_table(spark, str(tmp_path / "p.bin")).count() == 2
    lexicon = index.lexicon_offsets(index.posting_blocks(index.gaps(index.postings(lines))))
    files.write_lexicon(lexicon, str(tmp_path / "lex"))
    got = files.read_lexicon(spark, str(tmp_path / "lex")).orderBy("word_id").collect()
    assert [r.metadata_start for r in got][0] == 0 and all(a.metadata_end > a.metadata_start for a in got)


def test_repl(spark, engine, tmp_path, capsys):
    repl.interactive(engine, ["\n", "x y\n", "c \n", "c test zzz\n", "d test\n", "q\n", "d never\n"], 1)
    told = capsys.readouterr().out
    assert "not in the index: zzz" in told and "document 1, score 0.205433" in told and "begin with" in told and "no query" in told and told.count("results in") == 2
    (tmp_path / "q").write_text("1\ttest\n2\tdocument\n")
    (tmp_path / "e").write_text("1\n2\n5\n")
    done = repl.batch(engine, str(tmp_path / "q"), str(tmp_path / "e"), str(tmp_path / "out"), "d", 1)
    assert (done["queries"], done["missing"]) == (2, 1)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())[0] == "1\t1\t0.205433"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("0\tThis is a test document.\n")
    run = lambda: incremental.index_stream(spark, str(src), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "b.tsv").write_text("1\tAnother test here.\nbad\n")
    run()
    assert rows_of(incremental.load(spark, str(tmp_path / "ix")).search("test").orderBy("rank")) == [(1, 1, 0.205433), (2, 0, 0.163885)]
