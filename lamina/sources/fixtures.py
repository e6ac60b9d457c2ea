"""Generated inputs: plain ticks, trades that arrive backwards in time, and audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01 00:00:00"


def batch_size(records: int) -> int:
    """Rows of a batch for a load of so many."""
    for below, size in ((10_000, min(1000, records)), (100_000, 5000), (1_000_000, 10_000), (10_000_000, 20_000)):
        if records < below:
            return size
    return 25_000


def _numbered(spark: SparkSession, records: int, size: int, first: int) -> DataFrame:
    return spark.range(first, records).select(F.col("id"), F.expr(f"id div {size}").alias("b"), F.expr(f"id % {size}").alias("i"))


def _time(seconds: str):
    return F.expr(f"TIMESTAMP_NTZ '{START}' + make_dt_interval(0, 0, 0, {seconds})").alias("timestamp")


def simple(spark: SparkSession, records: int, size: int | None = None, first: int = 0) -> DataFrame:
    """(timestamp, symbol, price, volume): each batch starts ten minutes after the one before. Of so many
    records, those from `first` on."""
    rows = _numbered(spark, records, size or batch_size(records), first)
    return rows.select(
        _time("600 * b + i"),
        F.expr("element_at(array('SYM_A', 'SYM_B', 'SYM_C'), int(i % 3) + 1)").alias("symbol"),
        F.expr("round(100.0D + 10 * b + 0.01D * i, 2)").alias("price"),
        F.expr("10 + i").alias("volume"),
    )


def trading(spark: SparkSession, records: int, size: int | None = None, first: int = 0) -> DataFrame:
    """(timestamp, trade_id, symbol, user_id, order_id, price, volume, side): later batches are earlier
    in time."""
    size = size or batch_size(records)
    rows = _numbered(spark, records, size, first)
    step = max(1, size // 1000)
    walk = f"(({step} * i) % {-(-size // step) * step})"
    symbols = ", ".join(f"'{s}/USD'" for s in ("BTC", "ETH", "ADA", "SOL", "DOT", "LINK"))
    return rows.select(
        _time("i - 604800 * (b / 100.0D)"),
        F.expr(f"format_string('trade_%04d_%06d', b, {walk})").alias("trade_id"),
        F.expr(f"element_at(array({symbols}), int(i % 6) + 1)").alias("symbol"),
        F.expr(f"format_string('user_%06d', (1000 * b + {walk}) % 10000)").alias("user_id"),
        F.expr(f"format_string('order_%04d_%06d', b, {walk})").alias("order_id"),
        F.expr("double(50000 + 10 * (b % 1000) + i % 100)").alias("price"),
        F.expr("0.1D + 0.01D * (i % 10)").alias("volume"),
        F.expr("if(i % 2 = 0, 'buy', 'sell')").alias("side"),
    )


def audit_records(spark: SparkSession, records: int, size: int = 50_000, first: int = 0) -> DataFrame:
    """(record_id, timestamp, symbol, value, batch_num): a batch spans many days."""
    rows = _numbered(spark, records, size, first)
    return rows.select(F.col("id").alias("record_id"), _time("60 * i + 3600 * b"), F.lit("AUDIT").alias("symbol"), F.expr("double(id)").alias("value"), F.col("b").alias("batch_num"))
