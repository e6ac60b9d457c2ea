"""The one read operator: filter, exact global sort, exact limit, projection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.filters import FRACTIONAL, compile_filters


def ordering(name: str, kind: T.DataType, ascending: bool = True) -> list[Column]:
    """Sort keys: numbers, then NaN, then nulls, in either direction."""
    column = F.col(f"`{name}`")
    if isinstance(kind, FRACTIONAL):
        rank = F.when(column.isNull(), 2).when(F.isnan(column), 1).otherwise(0)
        return [rank.asc(), column.asc() if ascending else column.desc()]
    return [column.asc_nulls_last() if ascending else column.desc_nulls_last()]


def query(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    limit: int | None = None,
    sort_by: str | Sequence[str] | None = None,
    ascending: bool | Sequence[bool] = True,
    tie_break: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    strict: bool = True,
    offset: int = 0,
) -> DataFrame:
    """Rows of df that pass the filters, sorted, cut and projected. Lazy: Catalyst pushes the filter
    and the columns to the scans, and makes a sort with a limit one top-k of partial top-ks.

    limit None is no limit, 0 no rows; a negative one raises. offset skips that many rows before it. tie_break columns (ascending) make a
    sorted result the only possible one. Unknown sort columns raise.
    """
    if limit is not None and limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    passes = compile_filters(filters, df.schema, strict)
    out = df if passes is None else df.where(passes)
    if sort_by is not None:
        keys = [sort_by] if isinstance(sort_by, str) else list(sort_by)
        ways = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
        if missing := [k for k in [*keys, *tie_break] if k not in kinds]:
            raise ValueError(f"can't sort by unknown columns {missing}")
        if len(ways) != len(keys):
            raise ValueError("one direction for each sort column")
        order = [o for k, way in zip(keys, ways, strict=True) for o in ordering(k, kinds[k], way)]
        out = out.orderBy(*order, *(o for k in tie_break for o in ordering(k, kinds[k])))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*(f"`{c}`" for c in columns)) if columns is not None else out


def batches(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """df as Arrow batches of `size` rows (the last one may have fewer), in df's order. Workers make
    batches of that size; what crosses to the driver is whole batches, a partition at a time."""
    schema = df.limit(0).toArrow().schema

    def sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= size:
                table = pa.Table.from_batches(held)
                whole = rows - rows % size
                for at in range(0, whole, size):
                    yield table.slice(at, size)
                held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield pa.Table.from_batches(held)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sliced(parts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    def received() -> Iterator[pa.RecordBatch]:
        for row in df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(row[0]).read_all().cast(schema).to_batches()

    for table in sliced(received()):
        yield from table.combine_chunks().to_batches()
