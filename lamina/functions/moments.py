"""Points in time, without regard to the session's zone: as microseconds since the epoch.

A column with a zone holds instants. One without holds wall times, which are read as UTC, and so are
dates (their midnight), naive constants and strings without an offset.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
MICROSECOND, DAY = dt.timedelta(microseconds=1), 86_400_000_000


def micros_of(column: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch; null for a type that holds no time."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(column.cast("date")).cast("long")
        minutes = F.hour(column) * 60 + F.minute(column)
        seconds = F.date_part(F.lit("SECOND"), column)  # with its fraction, a decimal
        return days * DAY + minutes.cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long") * DAY
    return F.lit(None).cast("long")


def day_of(column: Column, kind: T.DataType) -> Column:
    """The UTC day."""
    if isinstance(kind, T.TimestampType):
        micros = F.unix_micros(column)
        return F.date_from_unix_date(F.floor((micros - F.pmod(micros, F.lit(DAY))) / DAY).cast("int"))
    return column.cast("date") if isinstance(kind, TEMPORAL) else F.lit(None).cast("date")


def moment(value: Any) -> dt.datetime:
    """A constant as an aware time in UTC. Raises ValueError for a string that is no ISO time."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip())
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)


def micros(value: Any) -> int:
    return (moment(value) - EPOCH) // MICROSECOND


def literal(value: Any, kind: T.DataType) -> Column:
    """A constant of that type, which the scan can compare with."""
    time = moment(value)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(micros(time)))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{time.replace(tzinfo=None).isoformat(' ')}'")
    return F.expr(f"DATE '{time.date().isoformat()}'")


def day(at: int) -> dt.date:
    """The UTC day of microseconds since the epoch; the first or last day that there is beyond those."""
    try:
        return (EPOCH + at * MICROSECOND).date()
    except OverflowError:
        return dt.date.min if at < 0 else dt.date.max
