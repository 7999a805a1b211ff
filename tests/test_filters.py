"""The filter compiler against a plain Python reading of the same rules."""

import math
import operator
import random
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from vexel.plans.filters import METADATA, Columns, Tagged, canonical, compile_filters, decode_metadata, encode_metadata
from vexel.plans.filters import tagged as tagged_columns

MISSING = object()
ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def holds(value, wanted):
    """Lenient: comparisons that Python refuses are false."""
    if value is MISSING:
        return False
    if not isinstance(wanted, dict):
        return value == wanted
    name, other = next(iter(wanted.items()))
    try:
        if name == "$ne":
            return value != other
        return other in value if name == "$in" else ORDER[name](value, other)
    except TypeError:
        return False


def expected(row, required, excluded, alternatives):
    dicts = lambda f: [f] if isinstance(f, dict) else list(f or [])
    get = lambda k: row.get(k, MISSING)
    ok = all(holds(get(k), v) for d in dicts(required) for k, v in d.items())
    some = [(k, v) for d in dicts(alternatives) for k, v in d.items()]
    if some:
        ok = ok and any(holds(get(k), v) for k, v in some)
    return ok and not any(get(k) is not MISSING and get(k) == v for d in dicts(excluded) for k, v in d.items())


VALUES = [1, 2, 1.0, 2.5, True, False, "1", "abc", "b", "", None, datetime(2021, 1, 1), datetime(2022, 1, 1, 5), ["a", "b"], [1, 2], ["abc"], [], 2**60, 2**60 + 1]
KEYS = "xyz"


def a_filter(rng):
    pick = lambda: rng.choice(VALUES)
    one = lambda: {rng.choice([*ORDER, "$ne", "$in"]): pick()} if rng.random() < 0.6 else pick()
    d = lambda n: {rng.choice(KEYS): one() for _ in range(n)}
    required = rng.choice([None, {}, d(1), d(2), [d(1), d(1)]])
    alternatives = rng.choice([None, [], [{}], d(1), [d(1), d(2)]])
    excluded = rng.choice([None, None, d(1), [{rng.choice(KEYS): pick()}, {rng.choice(KEYS): pick()}]])
    return required, excluded, alternatives


@pytest.fixture(scope="module")
def tagged(spark):
    rng = random.Random(5)
    rows = [{k: rng.choice(VALUES) for k in KEYS if rng.random() < 0.7} for _ in range(150)]
    data = [(i, encode_metadata(r)) for i, r in enumerate(rows)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("metadata", METADATA)])
    return rows, spark.createDataFrame(data, schema).cache()


def comparable(filters):
    """Range operators over lists aren't offered, nor exact order beyond 2 ** 53."""
    def bad(v):
        return isinstance(v, dict) and any(o in ORDER and (isinstance(x, list) or isinstance(x, int) and x > 2**53) for o, x in v.items())

    dicts = [d for f in filters for d in ([f] if isinstance(f, dict) else f or [])]
    return not any(bad(v) for d in dicts for v in d.values())


def test_generated_filters_match_python(tagged):
    rows, frame = tagged
    rng = random.Random(11)
    done, hits, columns, wanted = 0, 0, [], []
    while done < 120:
        f = a_filter(rng)
        if not comparable(f) or any(isinstance(d, list) and d == [{}] for d in f[:1]):
            continue
        columns.append(compile_filters(Tagged(), *f, strict=False).alias(f"f{done}"))
        wanted.append(([i for i, r in enumerate(rows) if expected(r, *f)], f))
        done += 1
    for part in range(0, done, 40):
        found = frame.select("id", *columns[part : part + 40]).collect()
        for n in range(part, part + 40):
            assert sorted(r["id"] for r in found if r[f"f{n}"]) == wanted[n][0], wanted[n][1]
            hits += len(wanted[n][0])
    assert hits > 500


def ids(frame, binding=None, **filters):
    return sorted(r[0] for r in frame.where(compile_filters(binding or Tagged(), **filters)).select("id").collect())


@pytest.fixture(scope="module")
def small(spark):
    from pyspark.sql import types as T

    rows = [{"v": 10}, {"v": 20, "d": datetime(2022, 1, 1)}, {}, {"v": None}, {"tags": ["a", "b"]}, {"name": "banana"}, {"v": math.nan}, {"m": {"inner": 1}}]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("metadata", METADATA)])
    return spark.createDataFrame([(i, encode_metadata(r)) for i, r in enumerate(rows)], schema).cache()


def test_edges(small):
    every = list(range(8))
    assert ids(small, metadata_filter={}) == every and ids(small, metadata_filter=[]) == every and ids(small) == every
    assert ids(small, metadata_filter=[{}]) == []
    assert ids(small, metadata_filter=[{}], or_filters=[{"v": 10}]) == [0]
    with pytest.raises(TypeError):
        compile_filters(Tagged(), [{}], {"v": 1})
    assert ids(small, or_filters=[{}, {}]) == every
    assert ids(small, metadata_filter={"v": {"$ne": 10}}) == [1, 3, 6]
    assert ids(small, metadata_filter={"v": None}) == [3]
    assert ids(small, metadata_filter={"v": math.nan}) == []
    assert ids(small, exclude_filter={"v": 10}) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(small, exclude_filter={"v": {"$gt": 5}}) == every
    assert ids(small, exclude_filter={"m": {"inner": 1}}) == [0, 1, 2, 3, 4, 5, 6]
    assert ids(small, metadata_filter={"tags": {"$in": "a"}}) == [4] and ids(small, metadata_filter={"name": {"$in": "nan"}}) == [5]
    assert ids(small, metadata_filter={"m": {"$in": "inner"}}) == [7]
    assert ids(small, metadata_filter={"v": {"$gte": 10, "$lte": 10}}, multi_op="all", strict=False) == [0]
    assert ids(small, metadata_filter={"v": {"$gte": 10, "$lte": 10}}, strict=False) == [0, 1]


def test_invalid_and_strict(small):
    for kind in ("metadata_filter", "or_filters"):
        with pytest.raises(ValueError, match="Invalid operator"):
            compile_filters(Tagged(), **{kind: {"v": {"$bad": 1}}})
    with pytest.raises(PySparkException, match="TypeError"):
        ids(small, metadata_filter={"v": {"$gt": 5}})  # one value is None
    with pytest.raises(PySparkException, match="TypeError"):
        ids(small, metadata_filter={"name": {"$gt": 5}})


def test_columns_binding(spark):
    rows = [(0, 1, 1.5, "abc", True, datetime(2024, 1, 1), ["x"]), (1, 2, math.nan, None, False, None, ["y", "x"]), (2, None, None, "b", None, datetime(2024, 2, 1), None)]
    frame = spark.createDataFrame(rows, "id long, i int, d double, s string, b boolean, t timestamp_ntz, a array<string>")
    get = lambda **f: ids(frame, Columns(frame.schema), **f)
    assert get(metadata_filter={"i": 1.0}) == [0] and get(metadata_filter={"i": "1"}) == [] and get(metadata_filter={"b": 1}) == [0]
    assert get(metadata_filter={"d": {"$gt": 0}}) == [0] and get(metadata_filter={"d": {"$ne": 1.5}}) == [1]
    assert get(metadata_filter={"a": ["y", "x"]}) == [1] and get(metadata_filter={"a": [1]}) == []
    assert get(metadata_filter={"a": {"$in": "x"}}) == [0, 1] and get(metadata_filter={"a": {"$in": 1}}) == []
    assert get(metadata_filter={"t": {"$gte": datetime(2024, 1, 15)}}) == [2]
    assert get(exclude_filter={"s": "abc"}) == [1, 2]
    with pytest.raises(PySparkException, match="TypeError"):
        get(metadata_filter={"s": {"$gt": 1}})


def test_filters_reach_the_scan(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    found = events.where(compile_filters(Columns(events.schema), {"value": {"$gte": 10}, "event_type": {"$ne": "view"}})).select("event_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(value" in plan and "Not(EqualTo(event_type,view))" in plan


def test_canonical_is_python_equality():
    for a in VALUES:
        for b in VALUES:
            assert (canonical(a) == canonical(b)) == (a == b), (a, b)


def test_metadata_come_back():
    given = {str(i): v for i, v in enumerate([*VALUES, {"a": [1, {"b": None}]}, ("x", 2), datetime(2020, 5, 6, 7, 8, 9, 10).date(), "a:b", -3, -2.5])}
    fields = ("kind", "num", "str", "ts", "items", "canon")
    back = decode_metadata({k: dict(zip(fields, v, strict=True)) for k, v in encode_metadata(given).items()})
    assert back == given and [type(v) for v in back.values()] == [type(v) for v in given.values()]


def test_tagged_columns_equal_encoded_rows(spark):
    """Typed columns on the executors give the map that single rows are encoded to."""
    values = [("a", 7, 20.5, datetime(2024, 1, 5, 3, 4, 5), date(2024, 2, 3)), ("é:", -1, 3.0, datetime(2024, 1, 5, 3, 4, 5, 60), None), (None, 2**40, 1e-7, None, date(1999, 12, 31)), ("", 0, 12345678.25, None, None), ("x", None, 1e22, None, None)]
    rows = spark.createDataFrame(values, "s string, n long, x double, t timestamp_ntz, d date")
    found = rows.select(tagged_columns(rows, rows.columns).alias("m")).collect()
    want = spark.createDataFrame([(encode_metadata({k: v for k, v in zip(rows.columns, row, strict=True) if v is not None}),) for row in values], T.StructType([T.StructField("m", METADATA)])).collect()
    assert [{k: tuple(v) for k, v in r["m"].items()} for r in found] == [{k: tuple(v) for k, v in r["m"].items()} for r in want]
