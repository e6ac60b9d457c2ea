"""Conservation audits: what was sent, what is found, where it is twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(sent: DataFrame, found: DataFrame, key: str, found_key: str | None = None) -> DataFrame:
    """Distinct keys that were sent and are not found."""
    keys = found.select(F.col(found_key or key).alias("_found"))
    return sent.select(key).distinct().join(keys, F.col(key).eqNullSafe(F.col("_found")), "left_anti")


def in_several_tiers(found: DataFrame, key: str, tier_column: str = "tier") -> DataFrame:
    """Keys that are in more than one tier. found: (key, tier)."""
    return found.groupBy(key).agg(F.countDistinct(tier_column).alias("n_tiers")).where("n_tiers > 1")


def report(sent: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row (sent, found, missing, duplicates): rows sent and found, distinct keys missing, and
    keys that are found more often than they were sent."""
    counts = sent.groupBy(key).agg(F.count("*").alias("_sent")).join(found.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_found")), F.col(key).eqNullSafe(F.col("_key")), "full")
    s, f = F.coalesce("_sent", F.lit(0)), F.coalesce("_found", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(total(s).alias("sent"), total(f).alias("found"), F.count_if((s > 0) & (f == 0)).alias("missing"), F.count_if(f > s).alias("duplicates"))


def reported_against_actual(reported: DataFrame, found: DataFrame, tier_column: str = "tier") -> DataFrame:
    """(tier, reported, actual) where they differ. reported: (tier, total_records)."""
    actual = found.groupBy(F.col(tier_column).alias("_tier")).agg(F.count("*").alias("actual"))
    both = reported.select(F.col(tier_column), F.col("total_records").alias("reported")).join(actual, F.col(tier_column) == F.col("_tier"), "full")
    r, a = F.coalesce("reported", F.lit(0)), F.coalesce("actual", F.lit(0))
    return both.where(r != a).select(F.coalesce(tier_column, "_tier").alias(tier_column), r.alias("reported"), a.alias("actual"))
