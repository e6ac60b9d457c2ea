"""Readers and writers of the three tiers, each a set of Parquet paths.

hot: batches as they came. warm: one folder a day, by each ROW's own time. cold: year/month/day
partitions, sorted within files (by time, if nothing else is asked for), so that row-group statistics
are zone maps. Days are those of UTC, whatever the session's zone.

Rows are dealt by hours when written, and the engine splits the hours that hold much and joins those
that hold little: a busy hour is many tasks, an idle day few files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.config import ColdConfig
from lamina.functions.moments import day, day_of, micros_of

DAY, HOUR, RUN = "_lamina_day", "_lamina_hour", "_lamina_run"
PARTS = ("_lamina_year", "_lamina_month", "_lamina_day")
#: The batch that a row came with, in every file that the store writes; readers don't see it.
BATCH = "_lamina_batch"
#: Files of up to so many rows are dealt to tasks by their number, so many to each; larger ones by bytes.
SMALL_FILE, FILES_OF_TASK = 1000, 200
SUFFIX = {"gzip": ".gz", "snappy": ".snappy", "zstd": ".zstd"}
PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Rows without a time are in no day; they get a partition of their own.
NO_DAY = "none"


def name_of(column: str) -> str:
    return f"`{column}`"


def dealt(df: DataFrame, time_column: str) -> DataFrame:
    hour = F.floor(micros_of(F.col(name_of(time_column)), df.schema[time_column].dataType) / 3_600_000_000)
    return df.withColumn(HOUR, hour).hint("rebalance", HOUR).drop(HOUR)


def dealt_by_files(df: DataFrame, time_column: str, tasks: int) -> DataFrame:
    """In ranges of time, and of a hash of the row where many share a time: small caps make many files of
    few bytes, which the engine, going by bytes, would leave to one task."""
    plain = [name_of(f.name) for f in df.schema.fields if isinstance(f.dataType, PLAIN)]
    return df.repartitionByRange(tasks, F.col(name_of(time_column)), F.xxhash64(*plain))


def write_batch(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_days(df: DataFrame, path: str, time_column: str, config: ColdConfig) -> None:
    """One folder a day."""
    day_name = F.date_format(day_of(F.col(name_of(time_column)), df.schema[time_column].dataType), "yyyy-MM-dd")
    parts = dealt(df, time_column).withColumn(DAY, F.coalesce(day_name, F.lit(NO_DAY)))
    parts.sortWithinPartitions(DAY, name_of(time_column)).write.option("maxRecordsPerFile", config.max_records_per_file).partitionBy(DAY).parquet(path)


def write_cold(df: DataFrame, path: str, time_column: str, config: ColdConfig, seen: Observation, measures: Sequence[Column], rows: int = 0) -> None:
    """One run, measured by the tasks that write it. rows: how many there are, where that is known."""
    on = day_of(F.col(name_of(time_column)), df.schema[time_column].dataType)
    tasks = -(-rows // (config.max_records_per_file * FILES_OF_TASK)) if 0 < config.max_records_per_file <= SMALL_FILE else 1
    df = dealt_by_files(df, time_column, tasks) if tasks > 1 else dealt(df, time_column)
    parts = df.observe(seen, *measures).withColumns(dict(zip(PARTS, (F.year(on), F.month(on), F.dayofmonth(on)), strict=True)))
    order = [F.col(name_of(c)).asc_nulls_last() for c in config.sort_columns or [time_column]]
    folder = local_folder(df.sparkSession, path)
    if tasks > 1 and folder and config.compression in SUFFIX and not config.bloom_filter_columns and all(isinstance(f.dataType, PLAIN) for f in df.schema.fields):
        # By all columns at last: a task that runs again then writes the same files.
        ordered = parts.sortWithinPartitions(*PARTS, *order, *(F.col(name_of(c)) for c in df.columns))
        written = sum(r[0] for r in ordered.mapInArrow(files_of_days(folder, config), "written long").collect())
        if written != seen.get["rows"]:
            raise RuntimeError(f"{seen.get['rows']} rows were to be written and {written} were")
        return
    writer = parts.sortWithinPartitions(*PARTS, *order).write
    writer = writer.option("compression", config.compression).option("maxRecordsPerFile", config.max_records_per_file)
    for column in config.bloom_filter_columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(*PARTS).parquet(path)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder in the machines' own (or mounted) file system that a path names, if it is one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.toUri().getPath() if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file" else None


def files_of_days(folder: str, config: ColdConfig):
    """Writes sorted rows as capped files of their days: rows written. Hadoop starts two processes (chmod)
    for each file that it makes in a local file system, which takes far longer than to write few rows."""
    cap, codec, run = config.max_records_per_file, config.compression, uuid.uuid4().hex

    def of(batches):
        task, made, written = TaskContext.get().partitionId(), 0, 0
        held, day, size = [], None, 0

        def flush() -> None:
            nonlocal made, written, size
            if not size:
                return
            names = ("__HIVE_DEFAULT_PARTITION__" if n is None else n for n in day)
            place = os.path.join(folder, *(f"{p}={n}" for p, n in zip(PARTS, names, strict=True)))
            os.makedirs(place, exist_ok=True)
            file = f"part-{task:05d}-{run}.c{made:06d}{SUFFIX[codec]}.parquet"
            beside = os.path.join(place, f".{file}.{uuid.uuid4().hex}")
            pq.write_table(pa.Table.from_batches(held), beside, compression=codec, store_schema=False)
            os.replace(beside, os.path.join(place, file))
            made, written, size = made + 1, written + size, 0
            held.clear()

        for batch in batches:
            days = list(zip(*(batch.column(p).to_pylist() for p in PARTS), strict=True))
            rows = batch.select([n for n in batch.schema.names if n not in PARTS])
            start = 0
            while start < len(days):
                if days[start] != day or size == cap:
                    flush()
                    day = days[start]
                end, most = start + 1, min(len(days), start + cap - size)
                while end < most and days[end] == day:
                    end += 1
                held.append(rows.slice(start, end - start))
                size, start = size + end - start, end
        flush()
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    return of


def read_paths(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """The rows of those folders; partition columns of their parents don't appear."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_cold(spark: SparkSession, schema: T.StructType, root: str, runs: Sequence[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of runs below root, in one scan however many they are. A range of times, in
    microseconds since the epoch, reads only the days that it touches."""
    if not runs:
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField(RUN, T.StringType()), *(T.StructField(p, T.IntegerType()) for p in PARTS)])
    out = spark.read.schema(wide).option("basePath", root).parquet(*runs)
    on = F.make_date(*PARTS)
    if low is not None:
        out = out.where(on >= F.expr(f"DATE '{day(low).isoformat()}'"))
    if high is not None:
        out = out.where(on <= F.expr(f"DATE '{day(high).isoformat()}'"))
    return out.drop(RUN, *PARTS)
