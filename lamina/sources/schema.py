"""The schema of a store: taken from the first batch, then fixed."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


class SchemaError(ValueError):
    """A batch that does not fit the store's schema."""


def castable(given: T.DataType, wanted: T.DataType) -> bool:
    """May values of one type be stored as the other without a change of meaning?"""
    if given == wanted or isinstance(given, T.NullType):
        return True
    widths = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    kinds = [type(given), type(wanted)]
    if all(k in widths for k in kinds):
        return widths.index(kinds[0]) < widths.index(kinds[1])
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return isinstance(given, times) and isinstance(wanted, times)


def fitted(given: T.StructType, schema: T.StructType, merge: bool = False) -> T.StructType:
    """The store's schema after a batch of the given one, which only `merge` may widen: then new columns
    are added to it, and missing ones are null. Raises SchemaError where the batch does not fit."""
    kinds, wanted = {f.name: f.dataType for f in given.fields}, {f.name for f in schema.fields}
    extra = [f for f in given.fields if f.name not in wanted]
    lacking = [f.name for f in schema.fields if f.name not in kinds]
    if not merge and (extra or lacking):
        raise SchemaError(f"columns {[f.name for f in extra]} are new and {lacking} are missing")
    for f in schema.fields:
        if f.name in kinds and not castable(kinds[f.name], f.dataType):
            raise SchemaError(f"column {f.name} is {kinds[f.name].simpleString()}, the store's is {f.dataType.simpleString()}")
    return nullable([*schema.fields, *extra])


def nullable(fields: Iterable[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields])


def conform(df: DataFrame, schema: T.StructType, merge: bool = False) -> tuple[DataFrame, T.StructType]:
    """df with the columns of fitted(), cast and in order, and that schema."""
    full = fitted(df.schema, schema, merge)
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in full.fields)), full


def conform_arrow(table: pa.Table, schema: T.StructType | None, merge: bool = False) -> tuple[pa.Table, T.StructType]:
    """conform() for an Arrow table. Times without a zone are wall times, which are UTC where the store's
    column has a zone; nanoseconds are cut to microseconds."""
    given = nullable(from_arrow_schema(table.schema, prefer_timestamp_ntz=True))
    full = given if schema is None else fitted(given, schema, merge)
    columns = []
    for field in to_arrow_schema(full):
        if field.name not in table.column_names:
            columns.append(pa.nulls(table.num_rows, field.type))
            continue
        column = table[field.name]
        if pa.types.is_dictionary(column.type):
            column = column.cast(column.type.value_type)
        columns.append(column.cast(field.type, safe=not pa.types.is_timestamp(column.type)))
    return pa.table(dict(zip(full.names, columns, strict=True))), full


def from_epoch(column: str, unit: str = "ns"):
    """A timestamp from a number since the epoch: nanoseconds lose what a microsecond can't hold."""
    per = {"ns": 1000, "us": 1}.get(unit)
    if per is not None:
        return F.timestamp_micros(F.floor(F.col(column) / per) if per == 1 else F.expr(f"`{column}` div {per}"))
    return {"ms": F.timestamp_millis, "s": F.timestamp_seconds}[unit](F.col(column))
