import datetime as dt
import math
import random

import pytest
from pyspark.sql import types as T

from lamina.functions.moments import micros
from lamina.functions.filters import FilterError, compile_filters, time_bounds
from lamina.operators.query import query

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("t", T.TimestampNTZType())])
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    pick = lambda *v: r.choice(v)
    return [(k, pick("a", "b", "c", None), pick(1.0, 2.0, 2.5, -1.0, float("nan"), None), pick(None, T0 + dt.timedelta(hours=r.randrange(100)))) for k in range(300)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def nan(v):
    return isinstance(v, float) and math.isnan(v)


def passes(value, wanted):
    """The grammar in plain Python."""
    if wanted is None:
        return False
    if isinstance(wanted, dict):
        return all(v is not None and value is not None and not nan(value) and not nan(v) and {">": value > v, ">=": value >= v, "<": value < v, "<=": value <= v}[op] for op, v in wanted.items())
    if isinstance(wanted, list):
        return any((w is None and value is None) or (nan(w) and nan(value)) or (w is not None and value is not None and value == w) for w in wanted)
    return value is not None and not nan(value) and value == wanted


CASES = [
    {},
    {"s": "a"},
    {"s": None},
    {"s": ["a", "b"]},
    {"s": ["a", None]},
    {"s": []},
    {"s": [None]},
    {"s": {">=": "b"}},
    {"x": 2.0},
    {"x": float("nan")},
    {"x": {">": 1.0}},
    {"x": {">=": 1.0, "<": 2.5}},
    {"x": {"<": 2.0}},
    {"x": {"<=": float("nan")}},
    {"x": {">": None}},
    {"x": [1.0, float("nan")]},
    {"x": {">": 1}},
    {"k": {">": 2.5}},
    {"t": {">=": T0 + dt.timedelta(hours=20), "<": T0 + dt.timedelta(hours=60)}},
    {"t": {">=": "2024-01-02 00:00:00"}},
    {"t": {">=": (T0 + dt.timedelta(hours=20)).replace(tzinfo=dt.UTC)}},
    {"s": ["a", "c"], "x": {">": 0.0}, "k": {"<": 200}},
]


@pytest.mark.parametrize("filters", CASES, ids=str)
def test_filters_match_plain_python(df, rows, filters):
    def moment(v):
        if isinstance(v, dict):
            return {o: moment(x) for o, x in v.items()}
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None)
        return dt.datetime.fromisoformat(v) if isinstance(v, str) and v.startswith("2024") else v

    names = [f.name for f in SCHEMA.fields]
    want = [r[0] for r in rows if all(passes(r[names.index(c)], moment(w)) for c, w in filters.items())]
    assert sorted(r.k for r in query(df, filters).select("k").collect()) == want


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("limit", [None, 0, 1, 7, 1000])
def test_sort_has_numbers_then_nan_then_null(df, rows, ascending, limit):
    def key(r):
        x = r[2]
        return (2, 0) if x is None else (1, 0) if nan(x) else (0, x if ascending else -x)

    want = [r[0] for r in sorted(rows, key=lambda r: (*key(r), r[0]))]
    got = [r.k for r in query(df, sort_by="x", ascending=ascending, limit=limit, tie_break=["k"]).collect()]
    assert got == (want if limit is None else want[:limit])


def test_errors_and_leniency(df):
    for bad in ({"nope": 1}, {"x": {"~": 1}}, {"s": 5}, {"k": "a"}, {"k": True}):
        with pytest.raises(FilterError):
            query(df, bad)
    assert query(df, {"nope": 1, "x": {"~": 1}}, strict=False).count() == 300
    with pytest.raises(ValueError):
        query(df, limit=-1)
    with pytest.raises(ValueError):
        query(df, sort_by="nope")


def test_extensions(df, rows):
    assert query(df, {"s": {"!=": "a"}}).count() == sum(r[1] not in ("a", None) for r in rows)
    assert query(df, {"s": {"is_null": True}}).count() == sum(r[1] is None for r in rows)
    assert query(df, {"s": {"==": "a"}}).count() == sum(r[1] == "a" for r in rows)


def test_time_bounds():
    a, b, kind = T0, T0 + dt.timedelta(days=2), T.TimestampNTZType()
    x, y = micros(a), micros(b)
    assert time_bounds({"t": {">=": a, "<": b}}, "t", kind) == (x, y)
    assert time_bounds({"t": [b, a]}, "t", kind) == (x, y)
    assert time_bounds({"t": a.isoformat() + "+00:00"}, "t", kind) == (x, x)
    assert time_bounds({"x": 1}, "t", kind) == (None, None)
    assert time_bounds({"t": ["junk", a]}, "t", kind) == (None, None)
    assert time_bounds({"t": a}, "t", T.LongType()) == (None, None)
    noon = dt.datetime(2024, 1, 1, 12)
    assert time_bounds({"t": noon}, "t", T.DateType()) == (micros(dt.date(2024, 1, 1)),) * 2


def test_plans_reach_the_scan(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    shown = plan(query(stored, {"k": {">": 5}, "t": {">=": T0}}, columns=["k"]))
    assert "GreaterThan(k,5)" in shown and "GreaterThanOrEqual(t," in shown
    assert "TakeOrderedAndProject" in plan(query(stored, sort_by="x", limit=3, tie_break=["k"]))
    assert compile_filters({}, SCHEMA) is None
