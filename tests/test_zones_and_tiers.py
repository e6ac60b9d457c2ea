"""Time zones, versions of the manifest, compaction, retention, background moves and the load command."""

import datetime as dt
import json
import logging
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import config as settings
from lamina.functions.filters import FilterError
from lamina.functions.moments import day_of, literal, micros, micros_of
from lamina.operators import query as reading
from lamina.operators import stats
from lamina.plans.store import Store, open_store
from lamina.sources import fixtures
from lamina.sources.manifest import CHECKPOINT, ConflictError, ManifestFile

UTC = dt.UTC


@pytest.fixture(params=["UTC", "America/Los_Angeles", "Pacific/Kiritimati"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def hours(spark, kind):
    """200 rows an hour apart, around a change of the clock in Los Angeles, as instants or as wall times of UTC."""
    rows = [(k, micros(dt.datetime(2024, 3, 9, 3, 30)) + k * 3_600_000_000 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, at long")
    wall = "TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, at / 1000000BD)"
    return df.withColumn("t", F.timestamp_micros("at") if kind == "timestamp" else F.expr(wall)), rows


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_every_tier_finds_what_a_plain_filter_finds(spark, zone, tmp_path, kind):
    df, rows = hours(spark, kind)
    assert df.schema["t"].dataType.simpleString() == kind
    assert [r[0] for r in df.select(micros_of(F.col("t"), df.schema["t"].dataType)).collect()] == [at for _, at in rows]
    want_days = [str((dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at)).date()) for _, at in rows]
    assert [str(r[0]) for r in df.select(day_of(F.col("t"), df.schema["t"].dataType)).collect()] == want_days
    filters = [
        {">=": dt.datetime(2024, 3, 10, 1, tzinfo=UTC)},
        {">=": "2024-03-10T20:00:00", "<": "2024-03-11 05:00:00+02:00"},
        {"<=": dt.datetime(2024, 3, 9, 4, 0)},
        {"==": dt.datetime(2024, 3, 10, 2, 30, 0, 23)},
        {">": dt.date(2024, 3, 16)},
    ]
    bounds = {">=": int.__ge__, "<": int.__lt__, "<=": int.__le__, "==": int.__eq__, ">": int.__gt__}
    wanted = [[k for k, at in rows if all(bounds[op](at, micros(v)) for op, v in f.items())] for f in filters]
    assert all(wanted)
    store = open_store(spark, str(tmp_path / "s"), "t")
    for part in range(4):
        store.ingest(df.where(F.col("k") % 4 == part))
    for move in (None, "hot", "hot", "hot", "hot", "warm"):
        if move:
            store.migrate(move)
        for f, want in zip(filters, wanted):
            assert sorted(r.k for r in store.query({"t": f}).collect()) == want
    assert {t: n["total_records"] for t, n in store.stats().items() if t != "total_records"} == {"hot": 0, "warm": 0, "cold": 200}
    assert store.stats()["cold"]["min_time"] == dt.datetime(2024, 3, 9, 3, 30, tzinfo=UTC)
    plan = store.query({"t": filters[1]})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_lamina_year" in plan and "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t" in plan


def test_dates_and_odd_constants(spark, zone, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), "d")
    df = spark.sql("SELECT DATE '2024-01-01' + CAST(id AS INT) AS d, id FROM range(60)")
    store.ingest(df)
    store.migrate("hot")
    store.migrate("warm")
    assert [r.id for r in store.query({"d": {">=": dt.date(2024, 1, 30), "<": "2024-02-02"}}, sort_by="id").collect()] == [29, 30, 31]
    assert [r.id for r in store.query({"d": [dt.date(2024, 1, 3), dt.date(2024, 2, 3)]}, sort_by="id").collect()] == [2, 33]
    with pytest.raises(FilterError):
        store.query({"d": {">=": "soon"}})
    assert spark.range(1).select(literal(dt.date(2024, 5, 6), T.DateType())).first()[0] == dt.date(2024, 5, 6)


def test_versions_and_a_second_writer(spark, tmp_path):
    path = str(tmp_path / "s")
    store = open_store(spark, path, hot_tier={"merge_rows": 0})
    table = fixtures.simple(spark, 10).toArrow()
    for _ in range(2 * CHECKPOINT + 3):
        store.ingest(table)
    names = ManifestFile(spark, path).children("_log")
    assert sum(n.endswith(".whole.json") for n in names) == 2 and len(names) == CHECKPOINT + 5
    again = open_store(spark, path, hot_tier={"merge_rows": 0})
    assert again.query().count() == 10 * (2 * CHECKPOINT + 3) == again.stats()["total_records"]
    again.ingest(table)
    with pytest.raises(ConflictError):
        store.ingest(table)
    assert store.query().count() == 10 * (2 * CHECKPOINT + 4)  # it has seen the other's batch
    assert store.ingest(table) and open_store(spark, path).stats()["total_records"] == 10 * (2 * CHECKPOINT + 5)


def test_a_known_origin_stays_known_when_its_rows_have_moved(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    table = fixtures.simple(spark, 10).toArrow()
    assert store.ingest(table, origin="a:0") and store.ingest(table, origin="a:1") and store.ingest(table, origin="b:0")
    for _ in range(3):
        store.migrate("hot")
    again = open_store(spark, str(tmp_path / "s"))
    assert not again.ingest(table, origin="a:1") and not again.ingest(table, origin="a:0") and again.ingest(table, origin="a:2")
    assert again.query().count() == 40


def test_small_batches_are_merged(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), hot_tier={"merge_rows": 100})
    for _ in range(11):
        store.ingest(fixtures.simple(spark, 30).toArrow())
    assert store.stats()["hot"]["entries"] == 5 and store.query().count() == 330
    assert store.compact("hot") == 330 and store.stats()["hot"]["entries"] == 1


def test_compaction_of_days_and_runs(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), hot_tier={"merge_rows": 0}, cold_tier={"sort_columns": ["symbol", "price"]})
    rows = fixtures.audit_records(spark, 4000, 500).drop("value").withColumnRenamed("batch_num", "price")
    for b in range(8):
        store.ingest(rows.where(F.col("price") == b))
    for _ in range(6):
        store.migrate("hot")
    store.migrate("warm", rows=1)
    assert store.stats()["warm"]["entries"] > store.stats()["warm"]["partitions"]
    store.compact("warm")
    assert store.stats()["warm"]["entries"] == store.stats()["warm"]["partitions"]
    store.migrate("warm", rows=1)
    store.migrate("warm")
    assert store.stats()["cold"]["entries"] > 1
    runs = len(store.scan(tiers_read=("cold",))._jdf.queryExecution().optimizedPlan().collectLeaves().toString().split("Relation")) - 1
    assert runs == 1  # one scan, however many runs
    store.compact("cold")
    assert store.stats()["cold"]["entries"] == 1 and store.query().exceptAll(rows).count() == 0 and store.query().count() == 4000
    assert store.build_index("record_id") == store.stats()["cold"]["total_records"] and store.build_index("record_id") == 0
    assert not store.vacuum()


def test_a_warm_folder_goes_with_its_last_day(spark, tmp_path):
    """Days that are left keep their folder and rows; an emptied folder is not left behind."""
    store = open_store(spark, str(tmp_path / "s"), hot_tier={"merge_rows": 0})
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 43_200)
    store.ingest(spark.range(6).select("id", at.alias("timestamp")))  # three or four days
    store.migrate("hot")
    folders = lambda: sorted(p.name for p in (tmp_path / "s" / "warm").iterdir() if p.is_dir())
    (folder,) = folders()
    moved = store.migrate("warm", rows=1)
    assert 0 < moved < 6 and folders() == [folder] and store.query().count() == 6 and not store.vacuum()
    assert store.migrate("warm") == 6 - moved
    assert not folders() and store.query().count() == 6 and not store.vacuum()


def test_retention_and_tiers(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), hot_tier={"merge_rows": 0})
    for k in range(5):
        store.tier("hot").ingest(fixtures.simple(spark, 10).withColumn("volume", F.lit(k).cast("long")))
    assert store.retain(2) == 30 and {r.volume for r in store.query().collect()} == {3, 4}
    store.tier("cold").ingest(fixtures.simple(spark, 7))
    store.tier("warm").ingest(fixtures.simple(spark, 5).toArrow())
    assert [store.tier(t).get_stats()["total_records"] for t in ("hot", "warm", "cold")] == [20, 5, 7]
    assert [store.tier(t).query({"price": {">=": 100.0}}).count() for t in ("hot", "warm", "cold")] == [20, 5, 7]
    with pytest.raises(ValueError):
        store.tier("tepid")


def test_warm_days_that_are_read_stay(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    store.ingest(fixtures.audit_records(spark, 4000, 4000))
    store.migrate("hot")
    store.query({"timestamp": {"<": dt.datetime(2024, 1, 1, 12)}}).count()
    store.migrate("warm", rows=1)
    gone = store.stats()["cold"]["min_time"]
    assert gone == dt.datetime(2024, 1, 2, tzinfo=UTC)


def test_early_and_least_evictions(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), warm_tier={"max_memory_mb": 1, "bytes_per_record": 1_048_576 // 5000})
    store.tier("warm").ingest(fixtures.audit_records(spark, 3200, 3200))
    store.maintain()
    assert store.stats()["cold"]["total_records"] == 0
    store.maintain(aggressive=True)
    assert 500 <= store.stats()["cold"]["total_records"] < 1000 + 1440


def test_pinned_tiers_are_read_from_memory(spark, tmp_path):
    with open_store(spark, str(tmp_path / "s")) as store:
        store.ingest(fixtures.audit_records(spark, 3000, 1000))
        store.migrate("hot")
        store.pin("warm").count()
        plan = lambda: store.query({"timestamp": {"<": dt.datetime(2024, 1, 2)}})._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan()
        store.migrate("warm", rows=1)
        assert "InMemoryTableScan" not in plan()
        assert store.query().count() == 3000


def test_arrow_batches_fit_the_schema(spark, zone, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), "t")
    at = [dt.datetime(2024, 1, 1, 12, tzinfo=UTC), None]
    first = pa.table({"t": pa.array(at, pa.timestamp("us", "UTC")), "s": pa.array(["a", None]).dictionary_encode(), "n": pa.array([1, 2], pa.int64())})
    store.ingest(first)
    nanos = pa.table({"n": pa.array([3], pa.int32()), "s": ["b"], "t": pa.array([at[0].replace(tzinfo=None)], pa.timestamp("ns"))})
    store.ingest(nanos)
    assert store.query({"t": at[0]}).count() == 2 and store.query({"t": {">=": "2024-01-01 12:00:00"}}).count() == 2
    for _ in range(2):
        store.migrate("hot")
    store.migrate("warm")
    assert store.query({"t": at[0]}).count() == 2 and store.query().count() == 3
    with pytest.raises(ValueError):
        store.ingest(nanos.drop_columns(["s"]))


def test_output_batches_keep_size_and_order(spark):
    r = random.Random(1)
    values = [r.random() for _ in range(1000)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v double, k long").repartition(7)
    found = list(reading.batches(reading.query(df, sort_by="v"), 64))
    assert [b.num_rows for b in found] == [64] * 15 + [40]
    assert [x for b in found for x in b.column("v").to_pylist()] == sorted(values)
    assert list(reading.batches(df.limit(0), 64)) == []


def test_background_moves_and_wait(spark, tmp_path):
    with open_store(spark, str(tmp_path / "s"), background=True, hot_tier={"max_records": 1000, "merge_rows": 0}) as store:
        for k in range(20):
            store.ingest(fixtures.simple(spark, 100).toArrow())
        store.wait()
        store.ingest(fixtures.simple(spark, 100).toArrow())
        store.wait()
        assert store.stats()["hot"]["total_records"] <= 1000 and store.query().count() == 2100
    assert open_store(spark, store.path).stats()["total_records"] == 2100


def test_numbering_needs_no_single_task(spark):
    df = spark.createDataFrame([(float(k % 50), k) for k in range(500)], "v double, k long").repartition(5)
    got = {r.k: r.n for r in stats.numbered(df, [F.col("v"), F.col("k")], "n").collect()}
    assert [got[k] for k in sorted(got, key=lambda k: (k % 50, k))] == list(range(1, 501))
    assert stats.numbered(df.limit(0), [F.col("v")], "n").count() == 0


def test_shared_configuration_and_logging(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"query": {"output_batch_size": 7}, "storage": {"base_path": str(tmp_path)}, "logging": {"file": "a.log", "level": "warning"}}))
    settings.reset_config()
    assert settings.get_config(tmp_path / "c.json") is settings.get_config() and settings.get_config().query.output_batch_size == 7
    shared = settings.get_config()
    settings.reset_config()
    assert settings.get_config().query.output_batch_size == 8192
    log = settings.logger(shared)
    log.warning("told")
    log.info("not told")
    settings.set_level("info")
    log.info("told later")
    text = settings.log_file(shared).read_text()
    assert settings.log_file(shared) == tmp_path / "logs" / "a.log" and "told later" in text and "not told" not in text
    for handler in [h for h in log.handlers if isinstance(h, logging.FileHandler)]:
        log.removeHandler(handler)
    settings.reset_config()


def test_no_shared_folder_is_an_error_on_a_cluster():
    from lamina.sources import shared

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other: other)})

    with pytest.raises(ValueError):
        shared.shared_base(Session())


def test_load_command(spark, tmp_path, capsys):
    from lamina import load

    tables = list(load.arrow_batches(spark, "simple", 2500, 1000))
    assert [t.num_rows for t in tables] == [1000, 1000, 500]
    assert pa.concat_tables(tables).equals(fixtures.simple(spark, 2500, 1000).toArrow())
    with Store(spark, str(tmp_path / "s"), background=True) as store:
        found = load.load(store, tables)
        assert found["rows"] == 2500 == store.query().count()


@pytest.mark.parametrize("most, merge", [(25, 0), (60, 15), (1_000_000, 25_000)])
def test_latest_batches_stay_wherever_their_rows_lie(spark, tmp_path, most, merge):
    """Budgets and merges decide where rows lie, not which batches are the latest."""
    store = open_store(spark, str(tmp_path / "s"), hot_tier={"max_records": most, "merge_rows": merge}, warm_tier={"max_memory_mb": 1, "bytes_per_record": 1_048_576 // 30})
    fixtures.simple(spark, 4).withColumn("volume", F.lit(9).cast("long")).write.parquet(str(tmp_path / "old"))
    for k in range(6):
        rows = fixtures.simple(spark, 10).withColumn("volume", F.lit(k).cast("long"))
        store.ingest(rows.toArrow() if k % 2 else rows)
        if k == 2:
            store.adopt(str(tmp_path / "old"))
            store.ingest(rows.limit(0))
    store.migrate("warm", rows=1)
    store = open_store(spark, store.path)
    found = lambda: sorted(r[:] for r in store.query().groupBy("volume").count().collect())
    assert store.retain_batches(6) == 0
    assert store.retain_batches(2) == 40 and found() == [(4, 10), (5, 10), (9, 4)] and store.audit_tiers().count() == 0
    assert store.retain_batches(2) == 0
    store.ingest(fixtures.simple(spark, 10).withColumn("volume", F.lit(6).cast("long")))
    assert store.retain_batches(2) == 10 and found() == [(5, 10), (6, 10), (9, 4)]
    assert store.retain_batches(0) == 20 and found() == [(9, 4)]


def test_small_caps_are_the_work_of_many_tasks(spark, tmp_path, monkeypatch):
    """Many files of few rows: dealt by number, capped, sorted, and the same rows in every type."""
    monkeypatch.setattr("lamina.sources.tiers.FILES_OF_TASK", 10, raising=False)
    at = "CASE WHEN id % 10 < 9 THEN timestamp_seconds(1700000000 + 40000 * (id % 4)) END"
    rows = spark.range(120).selectExpr(
        f"{at} AS t", f"CAST({at} AS TIMESTAMP_NTZ) AS n", "id AS k", "-id AS `a b`", "CAST(id AS DECIMAL(20, 3)) AS d", "CASE WHEN id % 3 > 0 THEN CAST(id AS STRING) END AS s",
        "CAST(CAST(id AS STRING) AS BINARY) AS b", "id % 2 = 0 AS o", "DATE '1969-12-31' + CAST(id AS INT) AS day", "CASE id WHEN 5 THEN double('NaN') ELSE id / 7 END AS f",
    )
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        store = open_store(spark, str(tmp_path / "s"), "t", warm_tier={"enabled": False}, cold_tier={"max_records_per_file": 2, "compression": "gzip", "sort_columns": ["a b"]})
        store.ingest(rows)
        assert store.migrate("hot") == 120 and store.audit_tiers().count() == 0
        assert store.query().exceptAll(rows).count() == 0 and store.query().count() == 120
        found = store.query().select("a b", F.input_file_name().alias("file")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    files: dict = {}
    for value, file in found:
        files.setdefault(file.rpartition("/")[2], []).append(value)
    assert all(len(v) <= 2 and v == sorted(v) and f.endswith(".gz.parquet") for f, v in files.items())
    assert len({f.split("-")[1] for f in files}) > 3
