"""Registered queries of the store's own operators, each with the SQL that it must match."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.moments import micros_of
from lamina.operators import audit, stats
from lamina.operators.query import ordering, query
from lamina.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
HOT_FROM, WARM_FROM = dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 15)
TIER_SQL = "CASE WHEN ts >= TIMESTAMP '2024-01-25 00:00:00' THEN 'hot' WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 'warm' ELSE 'cold' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"event_type": ["click", "view"], "ts": {">=": dt.datetime(2024, 1, 10)}, "value": {">": 45.0}}
    return query(table(spark, sf_dir, "events"), wanted, limit=10, sort_by="value", ascending=False, tie_break=["event_id"])


def events(**kwargs) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, "events"), **kwargs)


def lineitem(**kwargs) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, "lineitem"), **kwargs)


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("tier", stats.tier_of("ts", HOT_FROM, WARM_FROM))


def sort_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each row in a global sort."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    order = [*ordering("value", rows.schema["value"].dataType), *ordering("event_id", rows.schema["event_id"].dataType)]
    return stats.numbered(rows, order, "rn").select("event_id", "value", F.col("rn").cast("int").alias("rn"))


def limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(filters={"event_type": "purchase"}, limit=100)(spark, sf_dir).agg(F.count("*").alias("n"))


def merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each tier, then the best of those."""
    rows = tiered(spark, sf_dir).select("event_id", "value", "tier")
    parts = [query(rows.where(F.col("tier") == t), limit=20, sort_by="value", ascending=False, tie_break=["event_id"]) for t in ("hot", "warm", "cold")]
    return query(parts[0].unionAll(parts[1]).unionAll(parts[2]), limit=20, sort_by="value", ascending=False, tie_break=["event_id"])


def late_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the winners first, then their whole rows."""
    rows = table(spark, sf_dir, "events")
    winners = query(rows, limit=25, sort_by="value", ascending=False, tie_break=["event_id"], columns=["event_id"])
    return rows.join(F.broadcast(winners.withColumnRenamed("event_id", "_winner")), F.col("event_id") == F.col("_winner"), "left_semi")


def named_days(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def zones(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return stats.zone_maps(table(spark, sf_dir, "events"), "ts", columns)


def partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.col("ts")
    return table(spark, sf_dir, "events").groupBy(F.date_format(time, "yyyy-MM-dd").alias("partition_key"), F.year(time).alias("y"), F.month(time).alias("m"), F.dayofmonth(time).alias("d")).agg(F.count("*").alias("n"))


def overlapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of two tiers that hold all events between them, five days of them both."""
    rows = table(spark, sf_dir, "events")
    return query(rows, {"ts": {">=": WARM_FROM}}, columns=["event_id"]), query(rows, {"ts": {"<": JAN[20]}}, columns=["event_id"])


def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = overlapping(spark, sf_dir)
    return audit.in_several_tiers(a.withColumn("tier", F.lit("hot")).unionAll(b.withColumn("tier", F.lit("warm"))), "event_id")


def evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(stats.day_of("ts").alias("k")).agg(F.count("*").alias("sz"), F.max("ts").alias("la"))
    return stats.evict_least_recent(days, "k", "sz", "la", 1000).select(F.col("k").cast("string").alias("k"), "sz")


def evict_oldest_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("_batch", F.expr("int(event_id div 50)"))
    oldest = stats.evict_oldest_share(rows.select("_batch").distinct(), "_batch").withColumnRenamed("_batch", "_oldest")
    return rows.join(oldest, F.col("_batch") == F.col("_oldest"), "left_semi").drop("_batch")


def _moved_store(spark: SparkSession, sf_dir: str):
    """A store that took events in four batches and moved part of them to warm and to cold."""
    from lamina.plans.store import open_store

    store = open_store(spark, shared_folder(spark, "store"), "ts")
    rows = table(spark, sf_dir, "events")
    for quarter in range(4):
        store.ingest(rows.where(F.pmod(F.hash("event_id"), F.lit(4)) == quarter))
    store.migrate("hot")
    store.migrate("hot")
    store.migrate("warm", rows=1)
    return store, rows


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved_store(spark, sf_dir)[0].query()


def store_migrate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = _moved_store(spark, sf_dir)
    return store.audit(rows, "event_id")


def store_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _moved_store(spark, sf_dir)
    return store.query({"ts": {">=": dt.datetime(2024, 1, 10), "<": dt.datetime(2024, 1, 20)}})


def _of_events(spark: SparkSession, sf_dir: str, parts: int = 3, **overrides):
    """A store that took events in so many batches, and the events."""
    from lamina.plans.store import open_store

    store = open_store(spark, shared_folder(spark, "store"), "ts", **overrides)
    rows = table(spark, sf_dir, "events")
    for part in range(parts):
        store.ingest(rows.where(F.pmod(F.hash("event_id"), F.lit(parts)) == part))
    return store, rows


def store_fast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up in cold runs that have got bloom filters."""
    store, _ = _of_events(spark, sf_dir, 2)
    store.migrate("hot")
    store.migrate("warm")
    store.build_index("user_id")
    return store.fast_lookup("user_id", 42)


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest alone says of each tier, files of an older layout included."""
    store, _ = _moved_store(spark, sf_dir)
    store.adopt(f"{sf_dir}/events.parquet")
    found = store.stats()
    # A tier whose rows have all moved on has no times.
    told = lambda time: None if time is None else time.replace(tzinfo=None).isoformat(" ")
    rows = [(t, found[t]["total_records"], told(found[t]["min_time"]), told(found[t]["max_time"])) for t in ("hot", "warm", "cold")]
    said = spark.createDataFrame(rows, "tier string, total_records long, min_ts string, max_ts string")
    whole = said.agg(F.sum("total_records").alias("total_records"), F.min("min_ts").cast("timestamp_ntz").alias("min_ts"), F.max("max_ts").cast("timestamp_ntz").alias("max_ts"))
    return whole.withColumn("wrong_tiers", F.lit(store.audit_tiers().count()).cast("long"))


def store_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an older layout beside the store's own runs."""
    from lamina.plans.store import open_store

    store = open_store(spark, shared_folder(spark, "store"), "ts")
    old, rows = shared_folder(spark, "old"), table(spark, sf_dir, "events")
    rows.where("event_id % 2 = 0").write.parquet(old)
    store.adopt(old)
    store.ingest(rows.where("event_id % 2 = 1"))
    store.migrate("hot")
    store.migrate("warm")
    return store.query({"event_type": "click"})


def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another session finds after a move that broke off once it was published, and one before that."""
    from lamina.plans.store import open_store

    class Crash(Exception):
        pass

    def crash_at(step: str):
        def on_step(at: str) -> None:
            if at == step:
                raise Crash

        return on_step

    store, _ = _of_events(spark, sf_dir, 4)
    for step in ("published", "written"):
        try:
            store.migrate("hot", on_step=crash_at(step))
        except Crash:
            store = open_store(spark, store.path, "ts")
    return store.query()


def store_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets that each batch exceeds: rows found, and whether the tiers keep to their bounds."""
    n = table(spark, sf_dir, "events").count()
    store, rows = _of_events(spark, sf_dir, 6, hot_tier={"max_records": max(1, n // 3)}, warm_tier={"max_memory_mb": 1, "bytes_per_record": max(1, 3 * 1_048_576 // max(1, n))})
    hot, warm = store.stats()["hot"], store.stats()["warm"]
    kept = hot["capacity_pct"] <= 90 and warm["capacity_pct"] <= 85 and store.stats()["cold"]["total_records"] > 0
    return store.query().agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids")).withColumn("kept_to_bounds", F.lit(kept))


def store_no_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _of_events(spark, sf_dir, 2, warm_tier={"enabled": False})
    store.migrate("hot")
    store.migrate("hot")
    return store.tier("cold").query({"value": {">": 45.0}})


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, days and runs merged; an entry of each is left where there were several."""
    store, _ = _of_events(spark, sf_dir, 6, hot_tier={"merge_rows": 0}, cold_tier={"sort_columns": ["event_type", "value"]})
    for _ in range(3):
        store.migrate("hot")
        store.migrate("warm", rows=1)
    for tier in ("hot", "warm", "cold"):
        store.compact(tier)
    found = store.stats()
    merged = found["hot"]["entries"] <= 1 and found["warm"]["entries"] == found["warm"]["partitions"] and found["cold"]["entries"] == 1
    return store.query().groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).withColumn("merged", F.lit(merged))


def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cold files that are capped, compressed and sorted as the settings say."""
    cap = 100
    store, _ = _of_events(spark, sf_dir, 2, cold_tier={"max_records_per_file": cap, "compression": "gzip", "sort_columns": ["user_id"]}, warm_tier={"enabled": False})
    store.migrate("hot")
    store.migrate("hot")
    rows = store.scan().withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    before = F.lag("user_id").over(Window.partitionBy("file").orderBy("at"))
    files = rows.withColumn("falls", before > F.col("user_id")).groupBy("file").agg(F.count("*").alias("rows"), F.count_if("falls").alias("falls"))
    return files.agg(
        F.sum("rows").alias("n"), (F.max("rows") <= cap).alias("capped"), F.every(F.col("file").endswith(".gz.parquet")).alias("compressed"), (F.sum("falls") == 0).alias("sorted")
    )


def store_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, files and shares of capacity of each tier that holds anything, beside its rows."""
    store, _ = _moved_store(spark, sf_dir)
    found = store.stats(files=True)
    shares = {"hot": store.config.hot_tier.max_records, "warm": store.config.warm_tier.max_records}
    rows = []
    for tier in ("hot", "warm", "cold"):
        own = found[tier]
        share = own["capacity_pct"] is None if tier == "cold" else abs(own["capacity_pct"] - 100 * own["total_records"] / shares[tier]) < 1e-9
        # A tier whose rows have all moved on uses nothing.
        used = own["files"] >= own["entries"] and own["bytes"] > own["total_records"] if own["entries"] else own["total_records"] == own["files"] == own["bytes"] == 0
        rows.append((own["total_records"], used, share))
    told = spark.createDataFrame(rows, "n long, used boolean, share boolean")
    return told.agg(F.sum("n").alias("n"), F.every("used").alias("used"), F.every("share").alias("share"))


def store_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of times from a tier that is kept in memory, and the rest from files."""
    from lamina.sources.shared import materialised

    store, _ = _moved_store(spark, sf_dir)
    with store:
        store.pin("warm")
        return materialised(store.query({"ts": {">=": JAN[10], "<": JAN[20]}}))


def store_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest two of four batches, whichever tiers their rows lie in."""
    store, _ = _of_events(spark, sf_dir, 0, hot_tier={"merge_rows": 0})
    rows = table(spark, sf_dir, "events")
    for part in range(4):
        store.ingest(rows.where(F.pmod("event_id", F.lit(4)) == part))
    store.retain_batches(2)
    return store.query()


def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted result as Arrow batches: how many, their rows, and whether their order is the result's."""
    store, _ = _of_events(spark, sf_dir, 2)
    sizes, before, ordered = [], None, True
    for batch in store.batches({"event_type": "view"}, sort_by="value", tie_break=["event_id"]):
        sizes.append(batch.num_rows)
        keys = list(zip(batch.column("value").to_pylist(), batch.column("event_id").to_pylist(), strict=True))
        ordered &= keys == sorted(keys) and (before is None or before <= keys[0])
        before = keys[-1]
    return spark.createDataFrame([(len(sizes), sum(sizes), ordered)], "n_batches long, n long, ordered boolean")


def store_in_another_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants stored, moved and queried while the session's zone is far from UTC."""
    from lamina.plans.store import open_store
    from lamina.sources.shared import materialised

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        store = open_store(spark, shared_folder(spark, "store"), "ts")
        at = micros_of(F.col("ts"), T.TimestampNTZType())
        rows = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(at))
        for part in range(4):
            store.ingest(rows.where(F.pmod("event_id", F.lit(4)) == part))
        store.migrate("hot")
        store.migrate("hot")
        store.migrate("warm", rows=1)
        found = store.query({"ts": {">=": dt.datetime(2024, 1, 10, 1, tzinfo=dt.UTC), "<": "2024-01-20 20:00:00"}})
        return materialised(found.select("event_id", F.unix_micros("ts").alias("at")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files into a store, started twice: what is there already is not taken again."""
    from lamina.plans.store import open_store
    from lamina.streaming.ingest import ingest_stream

    store = open_store(spark, shared_folder(spark, "store"), "ts")
    rows, files, state = table(spark, sf_dir, "events"), shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    rows.repartition(4, "event_id").write.parquet(files)
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(files)
        ingest_stream(source, store, state, trigger={"availableNow": True}).awaitTermination()
    store.wait()
    return store.query()


def fixture_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.sources.fixtures import simple

    return simple(spark, 10_000, 5000)


def fixture_trading(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.sources.fixtures import trading

    return trading(spark, 10_000, 2000)


def fixture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.sources.fixtures import audit_records

    return audit_records(spark, 10_000, 2500)


def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nanoseconds and of seconds since the epoch as times."""
    from lamina.sources.schema import from_epoch

    at = micros_of(F.col("ts"), T.TimestampNTZType())
    rows = table(spark, sf_dir, "events").select("event_id", (at * 1000 + 999).alias("ns"), F.floor(at / 1_000_000).alias("s"))
    return rows.select("event_id", *(F.unix_micros(from_epoch(unit, unit)).alias(f"from_{unit}") for unit in ("ns", "s")))


def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "lineitem"), sort_by=["l_shipdate", "l_extendedprice"], ascending=[True, False], tie_break=["l_orderkey", "l_linenumber"], limit=500)


ALL = "SELECT * FROM events"
TOP = "ORDER BY value {} NULLS LAST, event_id LIMIT {}"
HOT_SQL, OLD_SQL = "ts >= TIMESTAMP '2024-01-15 00:00:00'", "ts < TIMESTAMP '2024-01-20 00:00:00'"
JAN = {n: dt.datetime(2024, 1, n) for n in (10, 20)}

#: name -> (query, SQL)
REGISTERED: dict[str, tuple[Query, str]] = {
    "scan_all": (events(), ALL),
    "filter_eq": (events(filters={"event_type": "click"}), f"{ALL} WHERE event_type = 'click'"),
    "filter_eq_flag": (lineitem(filters={"l_linestatus": "O"}), "SELECT * FROM lineitem WHERE l_linestatus = 'O'"),
    "filter_in": (events(filters={"event_type": ["click", "view"]}), f"{ALL} WHERE event_type IN ('click','view')"),
    "filter_in_int": (events(filters={"user_id": [1, 2, 3, 5, 8]}), f"{ALL} WHERE user_id IN (1,2,3,5,8)"),
    "filter_in_empty": (events(filters={"user_id": []}), f"{ALL} WHERE false"),
    "filter_none": (events(filters={"event_type": None}), f"{ALL} WHERE false"),
    "filter_empty": (events(filters={}), ALL),
    "filter_range": (events(filters={"ts": {">=": JAN[10], "<": JAN[20]}}), f"{ALL} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"),
    "filter_ge": (events(filters={"value": {">=": 45.0}}), f"{ALL} WHERE value >= 45.0"),
    "filter_gt": (events(filters={"value": {">": 45.0}}), f"{ALL} WHERE value > 45.0"),
    "filter_le": (events(filters={"value": {"<=": 10.0}}), f"{ALL} WHERE value <= 10.0"),
    "filter_lt": (events(filters={"value": {"<": 10.0}}), f"{ALL} WHERE value < 10.0"),
    "filter_combined": (
        events(filters={"event_type": ["click", "view"], "ts": {">=": JAN[10]}, "value": {">": 45.0}}),
        f"{ALL} WHERE event_type IN ('click','view') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND value > 45.0",
    ),
    "filter_string_range": (events(filters={"event_type": {">=": "p", "<": "t"}}), f"{ALL} WHERE event_type >= 'p' AND event_type < 't'"),
    "filter_string_time": (events(filters={"ts": {">=": "2024-01-10 00:00:00"}}), f"{ALL} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'"),
    "projection": (events(filters={"event_type": "view"}, columns=["event_id", "value"]), "SELECT event_id, value FROM events WHERE event_type = 'view'"),
    "topk_desc_10": (events(limit=10, sort_by="value", ascending=False, tie_break=["event_id"]), f"{ALL} {TOP.format('DESC', 10)}"),
    "topk_asc_10": (events(limit=10, sort_by="value", tie_break=["event_id"]), f"{ALL} {TOP.format('ASC', 10)}"),
    "topk_5": (events(limit=5, sort_by="value", ascending=False, tie_break=["event_id"]), f"{ALL} {TOP.format('DESC', 5)}"),
    "topk_50": (events(limit=50, sort_by="value", tie_break=["event_id"]), f"{ALL} {TOP.format('ASC', 50)}"),
    "topk_filtered": (events(filters={"event_type": "click"}, limit=1000, sort_by="value", ascending=False, tie_break=["event_id"]), f"{ALL} WHERE event_type = 'click' {TOP.format('DESC', 1000)}"),
    "topk_zero": (events(limit=0, sort_by="value"), f"{ALL} LIMIT 0"),
    "sort_full": (sort_full, "SELECT event_id, value, CAST(row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) AS INTEGER) AS rn FROM events"),
    "sort_multi_key": (multi_key_sort, "SELECT * FROM lineitem ORDER BY l_shipdate ASC NULLS LAST, l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 500"),
    "limit_count": (limit_count, "SELECT count(*) AS n FROM (SELECT * FROM events WHERE event_type = 'purchase' LIMIT 100) t"),
    "merge_topk": (
        merge_topk,
        "SELECT event_id, value, tier FROM (SELECT event_id, value, tier, row_number() OVER (PARTITION BY tier ORDER BY value DESC NULLS LAST, event_id) AS r "
        f"FROM (SELECT *, {TIER_SQL} AS tier FROM events) a) b WHERE r <= 20 {TOP.format('DESC', 20)}",
    ),
    "late_materialize": (late_materialize, f"SELECT e.* FROM events e JOIN (SELECT event_id FROM events {TOP.format('DESC', 25)}) k ON e.event_id = k.event_id"),
    "tier_stats": (
        lambda spark, sf_dir: stats.tier_stats(tiered(spark, sf_dir), "ts"),
        f"SELECT {TIER_SQL} AS tier, count(*) AS total_records, count(DISTINCT CAST(ts AS DATE)) AS total_partitions, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY 1",
    ),
    "zone_maps": (
        lambda spark, sf_dir: named_days(zones(spark, sf_dir, "value", "user_id"), "run_id"),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS record_count, min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_value, max(value) AS max_value, "
        "min(user_id) AS min_user_id, max(user_id) AS max_user_id FROM events GROUP BY 1",
    ),
    "zone_prune": (
        lambda spark, sf_dir: stats.zone_prune(zones(spark, sf_dir, "value"), [("value", ">", 200), ("value", "<=", 0.05)]).select(F.col("run_id").cast("string")),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id FROM events GROUP BY 1 HAVING max(value) > 200 AND min(value) <= 0.05",
    ),
    "zone_topk_runs": (
        lambda spark, sf_dir: named_days(stats.best_zones(zones(spark, sf_dir, "value").select("run_id", "max_value"), "value", 5), "run_id"),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, max(value) AS max_value FROM events GROUP BY 1 ORDER BY max_value DESC, run_id LIMIT 5",
    ),
    "partition_key": (
        partition_key,
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS partition_key, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, count(*) AS n FROM events GROUP BY 1,2,3,4",
    ),
    "dict_encode": (
        lambda spark, sf_dir: stats.dictionary(table(spark, sf_dir, "events"), "event_type", "event_id"),
        "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code, count(*) AS n FROM events GROUP BY event_type",
    ),
    "tier_union_distinct": (
        lambda spark, sf_dir: (lambda a, b: a.union(b).distinct())(*overlapping(spark, sf_dir)),
        f"SELECT event_id FROM events WHERE {HOT_SQL} UNION SELECT event_id FROM events WHERE {OLD_SQL}",
    ),
    "tier_intersect": (
        lambda spark, sf_dir: (lambda a, b: a.intersect(b))(*overlapping(spark, sf_dir)),
        f"SELECT event_id FROM events WHERE {HOT_SQL} INTERSECT SELECT event_id FROM events WHERE {OLD_SQL}",
    ),
    "audit_missing": (
        lambda spark, sf_dir: audit.missing(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"),
        "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    ),
    "audit_duplicates": (
        audit_duplicates,
        f"SELECT event_id, count(DISTINCT tier) AS n_tiers FROM (SELECT event_id, 'hot' AS tier FROM events WHERE {HOT_SQL} "
        f"UNION ALL SELECT event_id, 'warm' AS tier FROM events WHERE {OLD_SQL}) t GROUP BY event_id HAVING count(DISTINCT tier) > 1",
    ),
    "evict_lru": (
        evict_lru,
        "SELECT CAST(k AS VARCHAR) AS k, sz FROM (SELECT k, sz, sum(sz) OVER (ORDER BY la, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS freed "
        "FROM (SELECT CAST(ts AS DATE) AS k, count(*) AS sz, max(ts) AS la FROM events GROUP BY 1) a) b WHERE coalesce(freed, 0) < 1000",
    ),
    "evict_oldest_quarter": (
        evict_oldest_quarter,
        "SELECT e.* FROM events e JOIN (SELECT b FROM (SELECT b, row_number() OVER (ORDER BY b) AS r, count(*) OVER () AS n "
        "FROM (SELECT DISTINCT CAST(floor(event_id/50) AS INT) AS b FROM events) x) y WHERE r <= greatest(1, floor(n/4))) k ON CAST(floor(e.event_id/50) AS INT) = k.b",
    ),
    "store_roundtrip": (store_roundtrip, ALL),
    "store_time_range": (store_time_range, f"{ALL} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"),
    "store_migrate_audit": (store_migrate_audit, "SELECT count(*) AS sent, count(*) AS found, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS duplicates FROM events"),
    "point_lookup": (events(filters={"event_id": 42}), f"{ALL} WHERE event_id = 42"),
    "fixture_simple": (
        fixture_simple,
        "SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(600*(id//5000) + id%5000 AS BIGINT)) AS \"timestamp\", "
        "CASE (id%5000)%3 WHEN 0 THEN 'SYM_A' WHEN 1 THEN 'SYM_B' ELSE 'SYM_C' END AS symbol, CAST(round(100.0+10*(id//5000)+0.01*(id%5000),2) AS DOUBLE) AS price, CAST(10+id%5000 AS BIGINT) AS volume FROM range(10000) t(id)",
    ),
    "zone_prune_in": (
        lambda spark, sf_dir: stats.zone_prune(zones(spark, sf_dir, "user_id", "value"), [("user_id", "in", [-5, 3]), ("value", "in", [150.0, 220.0])]).select(F.col("run_id").cast("string")),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id FROM events GROUP BY 1 HAVING ((-5 BETWEEN min(user_id) AND max(user_id)) OR (3 BETWEEN min(user_id) AND max(user_id))) "
        "AND ((150.0 BETWEEN min(value) AND max(value)) OR (220.0 BETWEEN min(value) AND max(value)))",
    ),
    "store_fast_lookup": (store_fast_lookup, f"{ALL} WHERE user_id = 42"),
    "store_stats": (store_stats, "SELECT CAST(2 * count(*) AS BIGINT) AS total_records, min(ts) AS min_ts, max(ts) AS max_ts, CAST(0 AS BIGINT) AS wrong_tiers FROM events"),
    "store_legacy": (store_legacy, f"{ALL} WHERE event_type = 'click'"),
    "store_recovery": (store_recovery, ALL),
    "store_budget": (store_budget, "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, true AS kept_to_bounds FROM events"),
    "store_no_warm": (store_no_warm, f"{ALL} WHERE value > 45.0"),
    "store_compacted": (store_compacted, "SELECT event_type, count(*) AS n, min(event_id) AS first_id, true AS merged FROM events GROUP BY event_type"),
    "store_keep_latest": (store_keep_latest, f"{ALL} WHERE event_id % 4 >= 2"),
    "store_batches": (store_batches, "SELECT CAST(ceil(count(*) / 8192.0) AS BIGINT) AS n_batches, count(*) AS n, true AS ordered FROM events WHERE event_type = 'view'"),
    "store_files": (store_files, "SELECT CAST(count(*) AS BIGINT) AS n, true AS capped, true AS compressed, true AS sorted FROM events"),
    "store_usage": (store_usage, "SELECT CAST(count(*) AS BIGINT) AS n, true AS used, true AS share FROM events"),
    "store_pinned": (store_pinned, f"{ALL} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"),
    "store_in_another_zone": (
        store_in_another_zone,
        "SELECT event_id, epoch_us(ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-10 01:00:00' AND ts < TIMESTAMP '2024-01-20 20:00:00'",
    ),
    "store_stream": (store_stream, ALL),
    "fixture_trading": (
        fixture_trading,
        "SELECT TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(CAST(round((i - 604800 * (b / 100.0)) * 1000000) AS BIGINT)) AS \"timestamp\", "
        "printf('trade_%04d_%06d', b, w) AS trade_id, (['BTC/USD','ETH/USD','ADA/USD','SOL/USD','DOT/USD','LINK/USD'])[(i % 6) + 1] AS symbol, "
        "printf('user_%06d', (1000 * b + w) % 10000) AS user_id, printf('order_%04d_%06d', b, w) AS order_id, "
        "CAST(50000 + 10 * (b % 1000) + i % 100 AS DOUBLE) AS price, CAST(0.1 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (i % 10) AS volume, CASE i % 2 WHEN 0 THEN 'buy' ELSE 'sell' END AS side "
        "FROM (SELECT id // 2000 AS b, id % 2000 AS i, (2 * (id % 2000)) % 2000 AS w FROM range(10000) t(id)) x",
    ),
    "fixture_audit": (
        fixture_audit,
        "SELECT id AS record_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(60 * (id % 2500) + 3600 * (id // 2500)) AS \"timestamp\", 'AUDIT' AS symbol, CAST(id AS DOUBLE) AS value, id // 2500 AS batch_num FROM range(10000) t(id)",
    ),
    "epoch_times": (epoch_times, "SELECT event_id, epoch_us(ts) AS from_ns, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 AS from_s FROM events"),
    "windowed_counts": (
        lambda spark, sf_dir: _windowed(spark, sf_dir),
        "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").select(F.col("window.start").alias("window_start"), "event_type", "n")


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items()}
