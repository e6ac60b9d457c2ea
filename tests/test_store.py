import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.config import load_config
from lamina.operators import audit, stats
from lamina.plans.store import Store, open_store
from lamina.sources import fixtures
from lamina.sources.schema import SchemaError, from_epoch
from lamina.streaming.ingest import ingest_stream, windowed_counts


def keys(df, key="record_id"):
    return sorted(r[0] for r in df.select(key).collect())


@pytest.fixture
def filled(spark, tmp_path):
    """A store whose 4,000 records lie in all three tiers."""
    store = open_store(spark, str(tmp_path / "store"))
    rows = fixtures.audit_records(spark, 4000, 1000)
    for b in range(4):
        store.ingest(rows.where(F.col("batch_num") == b))
    store.migrate("hot")
    store.migrate("hot")
    store.migrate("warm", rows=1)
    return store, rows


def test_all_tiers_are_one_table(spark, filled):
    store, rows = filled
    found = store.stats()
    assert all(found[t]["total_records"] for t in ("hot", "warm", "cold")) and found["total_records"] == 4000
    assert keys(store.query()) == list(range(4000))
    assert set(store.query().columns) == set(rows.columns)
    assert store.audit(rows, "record_id").first().asDict() == {"sent": 4000, "found": 4000, "missing": 0, "duplicates": 0}
    assert store.audit_tiers().count() == 0


def test_rows_lie_in_the_day_of_their_own_time(spark, filled):
    store, rows = filled
    low, high = dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 9)
    want = keys(rows.where((F.col("timestamp") >= F.lit(low).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(high).cast("timestamp_ntz"))))
    assert keys(store.query({"timestamp": {">=": low, "<": high}})) == want and want


def test_time_range_prunes_partitions(filled):
    store, _ = filled
    store.migrate("warm")
    plan = store.query({"timestamp": {">=": dt.datetime(2024, 1, 1), "<": dt.datetime(2024, 1, 2)}})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_lamina_year" in plan
    assert "PushedFilters: [IsNotNull(timestamp)" in plan


def test_sorted_query_over_tiers_is_exact(filled):
    store, rows = filled
    got = [r.record_id for r in store.query({"value": {">=": 100.0}, "symbol": "AUDIT"}, sort_by="value", ascending=False, limit=50).collect()]
    assert got == list(range(3999, 3949, -1))
    assert [r.record_id for r in store.query(sort_by="value", offset=10, limit=3).collect()] == [10, 11, 12]
    used = store.stats(files=True)
    assert all(used[t]["bytes"] > 0 and used[t]["files"] > 0 for t in ("hot", "warm", "cold"))
    batches = list(store.batches(sort_by="record_id", limit=10_000))
    assert sum(b.num_rows for b in batches) == 4000 and isinstance(batches[0], pa.RecordBatch)
    assert [b.column("record_id")[0].as_py() for b in batches] == [0]


@pytest.mark.parametrize("step", ["written", "published"])
@pytest.mark.parametrize("tier", ["hot", "warm"])
def test_a_crash_while_moving_loses_and_doubles_nothing(spark, filled, step, tier):
    store, rows = filled

    def crash(at):
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.migrate(tier, on_step=crash)
    again = open_store(spark, store.path)
    assert keys(again.query()) == list(range(4000))
    left = again.vacuum()
    assert left and keys(again.query()) == list(range(4000)) and not again.vacuum()
    again.migrate(tier)
    assert again.audit(rows, "record_id").first()[1:] == (4000, 0, 0)


def test_budgets_move_data_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), load_config(overrides={"hot_tier": {"max_records": 1000}, "warm_tier": {"max_memory_mb": 1, "bytes_per_record": 1_048_576 // 1500}}))
    for b in range(5):
        store.ingest(fixtures.simple(spark, 3000, 600).where(F.col("volume") >= 0).where(F.floor((F.col("price") - 100) / 10) == b))
    found = store.stats()
    assert found["hot"]["total_records"] <= 900 and found["cold"]["total_records"] > 0 and found["total_records"] == store.query().count()


def test_no_warm_tier_goes_straight_to_cold(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), warm_tier={"enabled": False})
    store.ingest(fixtures.simple(spark, 100))
    store.migrate("hot")
    assert store.stats()["cold"]["total_records"] == 100


def test_nulls_odd_types_and_schema_rules(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), "t")
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 23:59:59' AS t, true AS b, 1.5BD AS d, DATE '2024-01-01' AS day, array(1, 2) AS a, CAST(NULL AS INT) AS n UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 3")
    store.ingest(rows)
    store.ingest(rows.limit(0))
    store.migrate("hot")
    store.migrate("warm")
    assert store.query().exceptAll(rows).count() == 0 and store.query().count() == 2
    assert store.query({"t": {">=": dt.datetime(2024, 1, 1)}}).count() == 1
    with pytest.raises(SchemaError):
        store.ingest(rows.drop("n"))
    with pytest.raises(SchemaError):
        store.ingest(rows.withColumn("n", F.lit("x")))
    wide = Store(spark, store.path, store.config, merge_schema=True)
    wide.ingest(rows.withColumn("new", F.lit(1)))
    assert wide.query().count() == 4 and wide.query({"new": 1}).count() == 2
    with pytest.raises(SchemaError):
        open_store(spark, str(tmp_path / "e")).query()


def test_arrow_batches_legacy_files_lookup_and_compaction(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    batch = fixtures.simple(spark, 50).toArrow().combine_chunks()
    assert store.ingest(batch.to_batches()[0], origin="one") and not store.ingest(batch, origin="one")
    store.ingest(batch)
    store.compact()
    assert store.stats()["hot"]["entries"] == 1 and store.query().count() == 100
    spark.createDataFrame(batch).write.parquet(str(tmp_path / "old"))
    store.adopt(str(tmp_path / "old"))
    assert store.query().count() == 150
    store.migrate("hot")
    store.migrate("warm")
    assert store.build_index("symbol") == 150  # what was adopted becomes a run
    assert store.fast_lookup("volume", 12).count() == 3
    with store:
        assert store.pin("cold").count() == 150


def test_streams(spark, tmp_path):
    rows = fixtures.simple(spark, 200)
    rows.write.parquet(str(tmp_path / "in"))
    store = open_store(spark, str(tmp_path / "s"))
    for _ in range(2):  # the second run finds nothing new
        running = ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), trigger={"availableNow": True})
        running.awaitTermination()
    assert store.query().count() == 200
    counts = windowed_counts(rows, "timestamp", "symbol").collect()
    assert sum(r.n for r in counts) == 200


def test_fixtures_match_their_known_values(spark):
    f1 = fixtures.simple(spark, 10_000, 5000).cache()
    assert f1.where("symbol = 'SYM_A'").count() == 3334 and f1.select("timestamp").distinct().count() == 5600
    assert f1.agg(F.max("price")).first()[0] == 159.99
    f2 = fixtures.trading(spark, 6000, 6000).cache()
    assert f2.where("side = 'buy'").count() == 3000 and f2.where("symbol = 'BTC/USD' AND side = 'sell'").count() == 0
    assert f2.where("price = 50099").count() == 60 and f2.select("trade_id").distinct().count() == 1000
    assert [fixtures.batch_size(n) for n in (500, 50_000, 10**8)] == [500, 5000, 25_000]


def test_config_layers(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"hot_tier": {"max_records": 5}, "query": {"output_batch_size": 9}}))
    config = load_config(tmp_path / "c.json", environ={"LAMINA_HOT_MAX_RECORDS": "7"})
    assert (config.hot_tier.max_records, config.query.output_batch_size) == (7, 9)
    config.save(tmp_path / "d.json")
    assert load_config(tmp_path / "d.json", environ={}).to_dict() == config.to_dict()
    assert config.storage.path("cold") == "./lamina_data/cold"
    with pytest.raises(KeyError):
        load_config(overrides={"hot_tier": {"nope": 1}}, environ={})


def test_audit_finds_faults(spark):
    sent = spark.range(10).withColumnRenamed("id", "k")
    found = spark.createDataFrame([(i, "hot") for i in range(8)] + [(3, "warm")], "k long, tier string")
    assert keys(audit.missing(sent, found, "k"), "k") == [8, 9]
    assert keys(audit.in_several_tiers(found, "k"), "k") == [3]
    assert audit.report(sent, found, "k").first()[:] == (10, 9, 2, 1)
    reported = spark.createDataFrame([("hot", 8), ("warm", 2)], "tier string, total_records long")
    assert audit.reported_against_actual(reported, found).collect()[0][:] == ("warm", 2, 1)


def test_eviction_and_dictionaries(spark):
    days = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "k string, sz long, la long")
    assert keys(stats.evict_least_recent(days, "k", "sz", "la", 6), "k") == ["a", "b"]
    assert keys(stats.evict_oldest_share(spark.range(3), "id"), "id") == [0]
    words = spark.createDataFrame([("x", 2), ("y", 1), ("x", 3)], "w string, at long")
    assert sorted(stats.dictionary(words, "w", "at").collect()) == [("x", 1, 2), ("y", 0, 1)]


def test_epoch_numbers_become_times(spark):
    row = spark.range(1).select(*(F.lit(n).alias(u) for u, n in (("ns", 1_500_000_123_456_789_999), ("us", 1_500_000_123_456_789), ("ms", 1_500_000_123_456), ("s", 1_500_000_123))))
    got = row.select(*(from_epoch(u, u).cast("string").alias(u) for u in row.columns)).first()
    assert got["ns"] == got["us"] == "2017-07-14 02:42:03.456789" and got["ms"] == "2017-07-14 02:42:03.456" and got["s"] == "2017-07-14 02:42:03"
