"""The filter grammar: {column: value | [values] | {operator: value, ...}}, all of it conjunctive.

Operators are >=, >, <= and <; ==, != and is_null are extensions. Constants are cast to the column's
type, so that comparisons reach the scan. What the grammar means where SQL would differ:

* times are instants, whatever the session's zone: naive constants, and strings without an offset, are UTC;
* a comparison with None holds for no row; None in a list matches nulls; an empty list matches none;
* NaN fails every comparison and equality, and matches only a NaN in a list.
"""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import math
import operator
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.moments import DAY, TEMPORAL, literal, micros

COMPARISONS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
EXTENSIONS = ("==", "!=", "is_null")
FRACTIONAL = (T.FloatType, T.DoubleType)
#: What each kind of column may be compared with.
CONSTANTS = (
    ((T.BooleanType,), (bool,)),
    ((T.NumericType,), (int, float, decimal.Decimal)),
    ((T.StringType,), (str,)),
    (TEMPORAL, (dt.datetime, dt.date, str)),
    ((T.BinaryType,), (bytes, bytearray)),
)


class FilterError(ValueError):
    """A filter that names an unknown column or operator, or compares unlike types."""


def constant(value: Any, kind: T.DataType, column: str) -> Column:
    for kinds, types in CONSTANTS:
        if isinstance(kind, kinds):
            if not isinstance(value, types) or (isinstance(value, bool) and bool not in types):
                raise FilterError(f"column {column} is {kind.simpleString()} and can't be compared with {value!r}")
            if isinstance(kind, TEMPORAL):
                try:
                    return literal(value, kind)
                except ValueError as error:
                    raise FilterError(f"column {column} can't be compared with {value!r}: {error}") from None
            if isinstance(kind, T.IntegralType) and isinstance(value, (float, decimal.Decimal)):
                return F.lit(value)  # casting 2.5 to an integer would change the comparison
            return F.lit(value).cast(kind)
    raise FilterError(f"column {column} of type {kind.simpleString()} can't be filtered")


def condition(name: str, wanted: Any, kind: T.DataType, strict: bool) -> list[Column]:
    column = F.col(f"`{name}`")
    number = [~F.isnan(column)] if isinstance(kind, FRACTIONAL) else []
    never = [F.lit(False)]
    if wanted is None:
        return never
    if isinstance(wanted, Mapping):
        out: list[Column] = []
        for op, value in wanted.items():
            if op not in COMPARISONS and op not in EXTENSIONS:
                if strict:
                    raise FilterError(f"unknown operator {op!r} on column {name}")
                continue
            if op == "is_null":
                out.append(column.isNull() if value else column.isNotNull())
            elif value is None or op != "!=" and isinstance(value, float) and math.isnan(value):
                out += never
            elif op == "!=":
                out.append(column != constant(value, kind, name))
            elif op == "==":
                out += [column == constant(value, kind, name), *number]
            else:
                out.append(COMPARISONS[op](column, constant(value, kind, name)))
                if op in (">=", ">"):
                    out += number
        return out
    if isinstance(wanted, (list, tuple, set, frozenset)):
        values = [constant(v, kind, name) for v in wanted if v is not None]
        found = [column.isin(values)] if values else []
        found += [column.isNull()] if len(values) < len(wanted) else []
        return [functools.reduce(operator.or_, found)] if found else never
    return [column == constant(wanted, kind, name), *number]


def compile_filters(filters: Mapping[str, Any] | None, schema: T.StructType, strict: bool = True) -> Column | None:
    """The filters as one condition, None if they are empty. With strict=False, unknown columns and
    operators are ignored."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out: list[Column] = []
    for name, wanted in (filters or {}).items():
        if name not in kinds:
            if strict:
                raise FilterError(f"no column {name!r}")
            continue
        out += condition(name, wanted, kinds[name], strict)
    return functools.reduce(operator.and_, out) if out else None


def time_bounds(filters: Mapping[str, Any] | None, column: str, kind: T.DataType | None) -> tuple[int | None, int | None]:
    """The closed range of times outside of which no row can pass, in microseconds since the epoch;
    None: no bound. Constants mean what the filter itself makes of them."""
    if not isinstance(kind, TEMPORAL):
        return None, None

    def moment(value: Any) -> int | None:
        try:
            at = micros(value)
        except (ValueError, TypeError):
            return None
        return at - at % DAY if isinstance(kind, T.DateType) else at

    wanted = (filters or {}).get(column)
    if isinstance(wanted, Mapping):
        lows = [moment(v) for op, v in wanted.items() if op in (">=", ">", "==")]
        highs = [moment(v) for op, v in wanted.items() if op in ("<=", "<", "==")]
    elif isinstance(wanted, (list, tuple, set, frozenset)):
        known = [moment(v) for v in wanted]
        if not known or None in known:
            return None, None
        return min(known), max(known)
    else:
        lows = highs = [moment(wanted)]
    lows, highs = [x for x in lows if x is not None], [x for x in highs if x is not None]
    return max(lows, default=None), min(highs, default=None)
