import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skeinworks.llm import radix


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@given(data=st.data())
def test_keys_keep_order(kind, data):
    v = np.array(data.draw(st.lists(st.floats(width=32 if kind is np.float32 else 64, allow_nan=False), min_size=1, max_size=50)), kind)
    k = radix.order_key(v)
    assert np.array_equal(radix.key_value(k, kind is np.float32), v + kind(0))
    order = np.argsort(k, kind="stable")
    assert np.array_equal(np.sort(v), v[order])


def rank(values, q):
    s = sorted(values)
    return s[max(1, (len(s) * q + 999) // 1000) - 1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("hot", rng.randrange(4), float(np.float32(rng.gauss(0, 1) * 10 ** rng.randrange(5)))) for _ in range(6000)]
    out += [(f"k{i % 40}", i % 3, float(i % 7)) for i in range(900)]
    return [*out, (" hot ", 1, -0.0), ("hot", 2, None), ("hot", 2, math.nan), ("hot", None, math.inf), (None, 1, 3.0), ("none", 1, None)]


def expected(rows, permille):
    groups = {}
    for k, g, v in rows:
        if k is not None and v is not None and not math.isnan(v):
            for key in ((k.strip(" "), g, False), (k.strip(" "), None, True)):
                groups.setdefault(key, []).append(v)
    return {key: [len(v), *[rank(v, q) for q in permille]] for key, v in groups.items()}


def test_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(radix, "FLUSH_ROWS", 1000)
    q = (10, 500, 999)
    df = spark.createDataFrame(rows, "c string, g int, v float").repartition(3)
    got = {(r["c"], r["g"], r["all_parts"]): [r["n"], r["p10"], r["p500"], r["p999"]] for r in radix.radix_percentiles(df, "c", "g", ["v"], q).collect()}
    assert got == expected(rows, q)


def test_bound(spark, rows):
    q = (250, 500, 900)
    df = spark.createDataFrame([r for r in rows if r[2] is None or not math.isinf(r[2])], "c string, g int, v float")
    want = expected([r for r in rows if r[2] is None or not math.isinf(r[2])], q)
    for r in radix.radix_percentiles(df, "c", "g", ["v"], q, exact=False).collect():
        for p, true in zip(q, want[r["c"], r["g"], r["all_parts"]][1:]):
            assert abs(r[f"p{p}"] - true) <= r["error_bound"] + 1e-9
            assert abs(r[f"p{p}"] - true) <= abs(true) * 2**-7


def test_wide_numbers(spark):
    """What a 32-bit float would round or overflow comes out as it is, or within its stated bound."""
    rng = random.Random(8)
    doubles = [16777217.0] * 3 + [1e300, -1e300, 5e-324, -0.0, 0.1, 0.1 + 2**-56, math.inf] + [16777216.0 + i for i in range(40)] + [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)]
    q = (1, 250, 500, 750, 990, 1000)
    rows = [("a", i % 5, v) for i, v in enumerate(doubles)]
    df = spark.createDataFrame(rows, "c string, g int, v double")
    want = expected(rows, q)
    for exact in (True, False):
        for r in radix.radix_percentiles(df, "c", "g", ["v"], q, exact=exact).collect():
            for p, true in zip(q, want[r["c"], r["g"], r["all_parts"]][1:]):
                assert r[f"p{p}"] == true if exact or math.isinf(true) else abs(r[f"p{p}"] - true) <= min(r["error_bound"], max(r["error_bound"], abs(true) * 2**-4))
            assert not exact or r["error_bound"] == 0
    longs = [2**53 + 1, 2**62 + 1, -(2**60) - 1, 7, 2**31, 2**31 + 1]
    got = radix.radix_percentiles(spark.createDataFrame([("a", v) for v in longs], "c string, v long"), "c", None, ["v"], (166, 333, 500, 666, 833, 1000)).first()
    for p, true in zip((166, 333, 500, 666, 833, 1000), sorted(longs)):
        assert abs(int(got[f"p{p}"]) - true) <= got["error_bound"] < 2**10
    decimals = spark.sql("SELECT 'a' AS c, explode(array(0.1BD, 12345678901234.567BD)) AS v")
    got = radix.radix_percentiles(decimals, "c", None, ["v"], (500, 1000)).first()
    assert got["p500"] == 0.1 and 0 < got["error_bound"] < 0.01
    with pytest.raises(ValueError):
        radix.radix_percentiles(spark.createDataFrame([("a", "1")], "c string, v string"), "c", None, ["v"])


@pytest.mark.parametrize("kind", ["date", "string", "timestamp", "bigint", "decimal(10,2)"])
def test_parts_of_any_type(spark, kind):
    """Days or names may be parts; two measures of different width go together."""
    df = spark.createDataFrame([(c, i % 3, float(i), i / 3) for i in range(90) for c in ("a", " a", "b")], "c string, i int, x float, y double")
    to = {"date": "date_add(date'2021-01-01', i)", "string": "concat('p ', i)", "timestamp": "timestamp_seconds(i)"}.get(kind, f"cast(i AS {kind})")
    df = df.selectExpr("c", f"if(i = 2, null, {to}) AS g", "i", "x", "y")
    got = radix.radix_percentiles(df, "c", "g", ["x", "y"], (500,), trim=False).collect()
    assert len(got) == 3 * 4 * 2 and {r["c"] for r in got} == {"a", " a", "b"} and radix.radix_percentiles(df, "c", "g", ["x", "y"], (500,)).count() == 2 * 4 * 2
    whole = {(r["c"], r["measure"]): (r["n"], r["p500"]) for r in got if r["all_parts"]}
    assert whole["a", "x"] == (90, 44.0) and whole["b", "y"] == (90, 44 / 3)
    part = {(r["g"], r["measure"]): (r["n"], r["p500"]) for r in got if r["c"] == "a" and not r["all_parts"]}
    assert part[None, "x"] == (30, 44.0) and len(part) == 6


def test_blocks_and_merging(spark, rows, monkeypatch, tmp_path):
    """Small flushes, merges on the way and many blocks change nothing."""
    monkeypatch.setattr(radix, "FLUSH_ROWS", 300)
    monkeypatch.setattr(radix, "MERGE_CELLS", 500)
    monkeypatch.setattr(radix, "BLOCK_BYTES", 1000)
    spark.createDataFrame(rows, "c string, g int, v double").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {(r["c"], r["g"], r["all_parts"]): [r["n"], r["p10"], r["p500"], r["p999"]] for r in radix.radix_percentiles(df, "c", "g", ["v"], (10, 500, 999)).collect()}
    assert got == expected(rows, (10, 500, 999))


def test_summaries_combine(spark, rows):
    df = spark.createDataFrame(rows, "c string, g int, v float")
    whole = radix.digit_histogram(df, "c", "g", ["v"])
    parts = [radix.digit_histogram(df.where(w), "c", "g", ["v"]) for w in ("g < 2", "g >= 2", "g IS NULL")]
    merged = radix.merge_histograms(*parts)
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    q = (250, 500, 900)
    want = expected(rows, q)
    got = radix.percentiles_of(merged, ["v"], q).collect()
    assert {(r["k"], r["g"], r["all_parts"]): r["n"] for r in got} == {k: w[0] for k, w in want.items()}
    for r in got:
        for p, true in zip(q, want[r["k"], r["g"], r["all_parts"]][1:]):
            assert r[f"p{p}"] == true or abs(r[f"p{p}"] - true) <= r["error_bound"]


def test_edges(spark):
    empty = spark.createDataFrame([], "c string, g int, v float")
    assert radix.radix_percentiles(empty, "c", "g", ["v"]).collect() == []
    clash = spark.createDataFrame([("a", 1, 2.0, "x", 9)], "c string, g int, v float, k string, V int")
    got = radix.radix_percentiles(clash, "c", None, ["v"], (500,)).collect()
    assert [tuple(r) for r in got] == [("a", True, "v", 1, 2.0, 0.0)]
