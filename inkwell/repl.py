"""Interactive and batch search over a collection: ``python -m inkwell.repl COLLECTION [K]`` or ``... COLLECTION K QUERIES EVALUATED OUT MODE``.

Interactive lines are a mode (``c`` or ``d``), a blank and a query; a line that begins with ``q`` or ``Q``, or the end of input, ends it.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .operators.search import MODES, Engine, missing_ids
from .sources import files


def parse(line: str) -> tuple[str, str] | None:
    """Mode and query of a line; None to quit. Raises ValueError for another mode or no query."""
    line = line.rstrip("\r\n")
    if line[:1] in ("q", "Q"):
        return None
    if line[:1] not in MODES:
        raise ValueError("begin with c (all terms) or d (any term), or q to quit")
    if not line[2:].strip():
        raise ValueError("no query")
    return line[0], line[2:]


def interactive(engine: Engine, lines: Iterable[str], k: int = 10, out=None) -> None:
    out = out or sys.stdout
    for line in lines:
        if not line.strip():
            continue
        try:
            asked = parse(line)
        except ValueError as e:
            print(e, file=out)
            continue
        if asked is None:
            return
        mode, query = asked
        began = time.time()
        found = engine.search(query, mode, k)
        rows = sorted(engine.with_snippets(found).collect(), key=lambda r: r["rank"])
        if lost := engine.missing(query):
            print("not in the index:", ", ".join(lost), file=out)
        for r in rows:
            print(f"{r['rank']}. document {r.doc_id}, score {r.score:g}\n{r.snippet}\n", file=out)
        print(f"{len(rows)} results in {1000 * (time.time() - began):.0f} ms", file=out)


def batch(engine: Engine, queries: str, evaluated: str, out: str, mode: str, k: int) -> dict[str, int | float]:
    """Run file of all evaluated queries in one job; counts and seconds."""
    began = time.time()
    known, wanted = files.read_queries(engine.spark, queries), files.read_evaluated(engine.spark, evaluated)
    files.write_results(engine.search_batch(known, mode, k, wanted), out)
    lost = missing_ids(known, wanted).count()
    return {"queries": wanted.count() - lost, "missing": lost, "seconds": round(time.time() - began, 3)}


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    engine = Engine.over(files.read_collection(spark, args[0]).select("doc_id", "text"))
    k = int(args[1]) if len(args) > 1 else 10
    if len(args) > 2:
        print(batch(engine, *args[2:6], k))
    else:
        interactive(engine, sys.stdin, k)


if __name__ == "__main__":
    main(sys.argv[1:])
