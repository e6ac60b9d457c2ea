"""Loads generated records into a store and queries them: python -m lamina.load 1000000 --mode trading."""

from __future__ import annotations

import argparse
import json
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from lamina.plans.store import Store, open_store
from lamina.sources import fixtures

MODES = {"simple": fixtures.simple, "trading": fixtures.trading}
QUERIES = {
    "simple": {"equal": {"symbol": "SYM_A"}, "in": {"symbol": ["SYM_A", "SYM_B"]}, "range": {"price": {">=": 100.0, "<": 150.0}}},
    "trading": {"equal": {"symbol": "BTC/USD"}, "flag": {"side": "buy"}, "in": {"symbol": ["BTC/USD", "ETH/USD"]}},
}


def arrow_batches(spark: SparkSession, mode: str, records: int, size: int) -> Iterator[pa.Table]:
    """The generated rows as Arrow tables of one batch each, made some batches at a time."""
    at_once = max(size, 1_000_000 // size * size)
    for start in range(0, records, at_once):
        table = MODES[mode](spark, min(records, start + at_once), size, start).toArrow()
        for at in range(0, table.num_rows, size):
            yield table.slice(at, size)


def load(store: Store, batches: Iterator[pa.Table] | list[pa.Table], report=lambda line: None) -> dict[str, float]:
    """Ingests the batches with eviction as the store's settings say: rows, seconds, rows a second until
    the last batch was durable, and the same until all moves were done. Making batches does not count."""
    rows, spent, best = 0, 0.0, 0.0
    for batch in batches:
        began = time.perf_counter()
        store.ingest(batch)
        took = time.perf_counter() - began
        rows, spent, best = rows + batch.num_rows, spent + took, max(best, batch.num_rows / took)
        report(f"{rows} rows, {rows / spent:.0f} rows/s; " + ", ".join(f"{t} {s['total_records']}" for t, s in store.stats().items() if t != "total_records"))
    began = time.perf_counter()
    store.wait()
    return {"rows": rows, "rows_per_s": rows / spent, "rows_per_s_settled": rows / (spent + time.perf_counter() - began), "best_batch_rows_per_s": best}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("records", type=int)
    parser.add_argument("--batch-size", type=int)
    parser.add_argument("--mode", choices=sorted(MODES), default="trading")
    parser.add_argument("--no-queries", action="store_true")
    parser.add_argument("--storage")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("lamina-load").getOrCreate()
    size = given.batch_size or fixtures.batch_size(given.records)
    with open_store(spark, given.storage or tempfile.mkdtemp(prefix="lamina-load-"), background=True) as store:
        found = load(store, arrow_batches(spark, given.mode, given.records, size), lambda line: print(line, flush=True))
        print(json.dumps({k: round(v) for k, v in found.items()}))
        for name, filters in ({} if given.no_queries else QUERIES[given.mode] | {"all": {}}).items():
            began = time.perf_counter()
            n = sum(b.num_rows for b in store.batches(filters, limit=100_000))
            print(f"{name}: {n} rows in {time.perf_counter() - began:.2f} s")


if __name__ == "__main__":
    main()
