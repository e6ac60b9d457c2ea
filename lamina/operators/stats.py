"""Statistics that the store decides by: tiers, zone maps, eviction choices, dictionaries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import moments
from lamina.functions.moments import literal
from lamina.sources.shared import materialised


def day_of(time_column: str, kind: T.DataType = T.TimestampNTZType()) -> Column:
    """The UTC day."""
    return moments.day_of(F.col(time_column), kind)


def tier_of(time_column: str, hot_from: dt.datetime, warm_from: dt.datetime, kind: T.DataType = T.TimestampNTZType()) -> Column:
    """hot, warm or cold by age."""
    time = F.col(time_column)
    return F.when(time >= literal(hot_from, kind), "hot").when(time >= literal(warm_from, kind), "warm").otherwise("cold")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with the place of each row in that order, from 1. Rows are range-partitioned, sorted and
    numbered within, and written once; the partitions' sizes, one number each, give the offsets."""
    placed = materialised(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part, at = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = sorted(r[:] for r in placed.groupBy(part).count().collect())
    before, rows = 0, []
    for number, size in sizes:
        rows.append((number, before))
        before += size
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], f"{name}_of long, {name}_before long")
    joined = placed.join(F.broadcast(offsets), part == F.col(f"{name}_of"))
    return joined.select(*(f"`{c}`" for c in df.columns), (F.col(f"{name}_before") + at + 1).alias(name))


def tier_stats(df: DataFrame, time_column: str, tier_column: str = "tier") -> DataFrame:
    day = day_of(time_column, df.schema[time_column].dataType)
    return df.groupBy(tier_column).agg(F.count("*").alias("total_records"), F.countDistinct(day).alias("total_partitions"), F.min(time_column).alias("min_ts"), F.max(time_column).alias("max_ts"))


def zone_maps(df: DataFrame, time_column: str, columns: Sequence[str] = ()) -> DataFrame:
    """Per day: rows, and smallest and largest value of the time and of each given column."""
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(day_of(time_column, df.schema[time_column].dataType).alias("run_id")).agg(F.count("*").alias("record_count"), F.min(time_column).alias("min_ts"), F.max(time_column).alias("max_ts"), *bounds)


def can_contain(op: str, value, column: str) -> Column:
    """May a zone with these bounds hold a row that passes? Unknown operators: it may. "in" takes a list."""
    low, high = F.col(f"min_{column}"), F.col(f"max_{column}")
    if op == "in":
        found = F.lit(False)
        for v in value:
            found = found | can_contain("==", v, column)
        return found
    v = F.lit(value)
    return {">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v, "==": (low <= v) & (high >= v)}.get(op, F.lit(True))


def zone_prune(zones: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Zones that may hold rows that pass every (column, operator, value)."""
    for column, op, value in conditions:
        zones = zones.where(can_contain(op, value, column))
    return zones


def best_zones(zones: DataFrame, column: str, n: int, ascending: bool = False) -> DataFrame:
    """The n zones that promise most for a top-k by that column."""
    bound = F.col(f"min_{column}").asc() if ascending else F.col(f"max_{column}").desc()
    return zones.orderBy(bound, "run_id").limit(n)


def evict_least_recent(partitions: DataFrame, key: str, size: str, last_access: str, need: int) -> DataFrame:
    """Partitions in order of last access until what they free reaches `need`. Partitions are days,
    so the one ordered window is over a few thousand rows, however many rows the days hold."""
    before = Window.orderBy(last_access, key).rowsBetween(Window.unboundedPreceding, -1)
    freed = partitions.withColumn("_freed", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return freed.where(F.col("_freed") < need).drop("_freed")


def evict_oldest_share(batches: DataFrame, key: str, share: float = 0.25) -> DataFrame:
    """The oldest share of batches, one at least."""
    rank = "_rank"
    ranked = numbered(batches.select(key), [F.col(key)], rank)
    most = max(1, int(ranked.count() * share))
    return ranked.where(F.col(rank) <= most).select(key)


def dictionary(df: DataFrame, column: str, arrival: str) -> DataFrame:
    """Codes of a column's values in order of first arrival, with their counts."""
    values = df.groupBy(column).agg(F.min(arrival).alias("_first"), F.count("*").alias("n"))
    return numbered(values, [F.col("_first")], "_code").select(column, (F.col("_code") - 1).alias("code"), "n")
