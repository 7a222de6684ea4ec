"""Edge cases of the data-preparation operators, and brute force on small tables."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.operators import badrows, heavykeys, profile, regular, trailing
from skeinworks.plans import problems
from skeinworks.sources import chunks
from tests.support import DATA, database

D = dt.date


def day(n):
    return D(2021, 1, 1) + dt.timedelta(days=n)


# ---- key totals


def test_key_totals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 50 + [f"k{i}" for i in range(300)]), rng.choice([None, math.nan, *range(9)])) for _ in range(5000)] + [(None, 3.0), (" hot ", 1.0), ("", 2.0)]
    want = defaultdict(lambda: [0, 0, 0.0])
    for k, v in rows:
        w = want[None if k is None else k.strip(" ")]
        w[0] += 1
        if v is not None and not math.isnan(v):
            w[1] += 1
            w[2] += v
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(7)
    got = {r["k"]: [r["n_rows"], r["v_n"], r["v_sum"] or 0.0] for r in heavykeys.key_totals(df, "k", ["v"], block_keys=40).collect()}
    assert got == {k: list(w) for k, w in want.items()}


def test_key_totals_flush(spark, monkeypatch):
    monkeypatch.setattr(heavykeys, "FLUSH_KEYS", 3)
    df = spark.createDataFrame([(f"k{i % 11}", 1.0) for i in range(1000)], "k string, v double").coalesce(1)
    assert {r["n_rows"] for r in heavykeys.key_totals(df, "k", ["v"]).collect()} == {90, 91}


def test_heavy_keys_edges(spark):
    empty = spark.createDataFrame([], "channel string, x int")
    assert heavykeys.heavy_keys(empty, "channel", 0.02).collect() == []
    nulls = spark.createDataFrame([(None,)] * 98 + [("a",), ("a",)], "channel string")
    assert [r[0] for r in heavykeys.heavy_keys(nulls, "channel", 0.02).collect()] == ["a"]
    assert heavykeys.heavy_keys(nulls, "channel", 0.03).collect() == []


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 5)], "channel string, Channel string, n double, k int")
    assert [tuple(r) for r in heavykeys.key_totals(df, "channel", ["n"]).collect()] == [("a", 1, 1, 1.0)]
    assert [tuple(r) for r in heavykeys.key_totals(df, "Channel", ["k"]).collect()] == [("b", 1, 1, 5.0)]


# ---- trailing totals


def test_trailing_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", " a", "c"]), day(rng.randrange(90)), float(rng.randrange(5))) for _ in range(120)] + [("a", day(3), None), ("b", day(5), math.nan), (None, day(1), 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "c string, d date, v double")
    per = defaultdict(lambda: defaultdict(float))
    for c, d, v in rows:
        if c is not None and d is not None:
            per[c.strip(" ")][d] += 0.0 if v is None or math.isnan(v) else v
    want = {}
    for c, days in per.items():
        x = min(days)
        while x <= max(days):
            want[c, x] = [sum(days.get(x - dt.timedelta(days=i), 0.0) for i in range(p)) for p in (2, 30)]
            x += dt.timedelta(days=1)
    got = {(r["c"], r["d"]): [r["v_sum_2d"], r["v_sum_30d"]] for r in trailing.trailing_totals(df, "c", "d", ["v"], (30, 2)).collect()}
    assert got == want


def test_trailing_edges(spark):
    empty = spark.createDataFrame([], "c string, d date, v float")
    assert trailing.trailing_totals(empty, "c", "d", ["v"]).collect() == []
    clash = spark.createDataFrame([("a", day(0), 1.0, "x", "y")], "c string, d date, v double, __e string, __d string")
    calendar = spark.createDataFrame([(day(0),), (day(0),)], "date date")
    assert [tuple(r) for r in trailing.trailing_totals(clash, "c", "d", ["v"], [7], calendar=calendar).collect()] == [("a", day(0), 1.0, 1.0 / 7)]
    outside = spark.createDataFrame([("a", D(1970, 1, 1), 1.0)], "c string, d date, v double")
    assert trailing.trailing_totals(outside, "c", "d", ["v"], calendar=calendar).collect() == []
    with pytest.raises(ValueError):
        trailing.trailing_totals(empty, "c", "d", ["v"], [0])


def test_registered_trailing(spark):
    """Unrounded, against the same SQL without its rounding, to the order of summation."""
    sql = problems.ORACLE["p4_trailing_rounded"].replace("round(", "(").replace(", 0) + 0 AS", ") AS")
    want = database().sql(f"SELECT * FROM ({sql})")
    names = want.columns
    want = {r[:2]: r[2:] for r in want.fetchall()}
    got = {(r["channel"], r["date"]): [r[c] for c in names[2:]] for r in problems.QUERIES["p4_trailing"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for k, w in want.items() for x, y in zip(got[k], w))
    assert any(0 < x < 0.5 for w in got.values() for x in w)


# ---- regular series


def test_regular_series(spark):
    df = spark.createDataFrame([("a", day(0), 2.0), ("a", day(0), 4.0), ("a ", day(4), 8.0), ("b", day(1), None)], "c string, d date, v double")
    got = sorted(tuple(r) for r in regular.regular_series(df, "c", "d", "v", hold=2).collect())
    assert got == [
        ("a", day(0), 2, 3.0, 1.0, "observed"),
        ("a", day(1), 0, 3.0, 1.0, "filled"),
        ("a", day(2), 0, None, 0.0, "missing"),
        ("a", day(3), 0, None, 0.0, "missing"),
        ("a", day(4), 1, 8.0, 1.0, "observed"),
        ("b", day(1), 1, None, 0.0, "observed"),
    ]


def test_regular_cells(spark):
    df = spark.createDataFrame([("a", D(1970, 1, 3), 1.0), ("a", D(1970, 1, 6), 4.0), ("a", D(1970, 1, 9), 9.0)], "c string, d date, v double")
    got = sorted(tuple(r)[1:] for r in regular.regular_series(df, "c", "d", "v", cell_days=7, hold=None).collect())
    assert got == [(D(1970, 1, 1), 2, (3 * 1.0 + 2 * 4.0) / 5, 1.0, "observed"), (D(1970, 1, 8), 1, (4.0 + 9.0) / 2, 1.0, "observed")]
    assert regular.regular_series(df.limit(0), "c", "d", "v").collect() == []


def test_regular_in_time(spark):
    """Time-weighted within a cell, over midnight, to the end of the hold; against the function of seconds it stands for."""
    rng, hour = random.Random(5), 3600
    rows = [(rng.choice(["a", "a", "a", " b "]), rng.randrange(0, 12 * 24) * 900 - 86_400, rng.choice([1.0, 2.0, 5.0, None, math.nan])) for _ in range(60)]
    df = spark.createDataFrame(rows, "e string, s long, v double").selectExpr("e", "timestamp_seconds(s) AS at", "v", "1 AS cell", "2 AS t").repartition(3)
    got = {(r["e"], int(r["cell_start"].replace(tzinfo=dt.timezone.utc).timestamp())): r for r in regular.regular_series_in_time(df, "e", "at", "v", cell_seconds=6 * hour, hold_seconds=5 * hour).collect()}
    want = {}
    for e in ("a", "b"):
        taken = defaultdict(list)
        for k, s, v in rows:
            if k.strip() == e:
                taken[s].append(v)
        times = sorted(taken)
        for s, after in zip(times, [*times[1:], (times[-1] // (6 * hour) + 1) * 6 * hour]):
            real = [v for v in taken[s] if v is not None and not math.isnan(v)]
            value = sum(real) / len(real) if real else None
            for q in range(s, after, 900):
                c = want.setdefault((e, q // (6 * hour) * 6 * hour), [0, 0.0, 0, 0])
                c[0] += len(taken[s]) if q == s else 0
                c[3] += 900
                if value is not None and q < s + 5 * hour:
                    c[1] += value * 900
                    c[2] += 900
    assert got.keys() == want.keys()
    for k, (n, mass, held, lasts) in want.items():
        r = got[k]
        assert r["n_rows"] == n and math.isclose(r["coverage"], held / lasts) and r["state"] == ("observed" if n else "filled" if held else "missing")
        assert (r["value"] is None) == (held == 0) and (held == 0 or math.isclose(r["value"], mass / held))
    assert regular.regular_series_in_time(df.limit(0), "e", "at", "v", cell_seconds=60).collect() == []
    with pytest.raises(ValueError):
        regular.regular_series_in_time(df, "e", "at", "v", cell_seconds=0)


# ---- records

CSV, FWF = problems.LAYOUTS["csv"], problems.LAYOUTS["fwf"]


def strict(line, layout=CSV):
    return badrows.parse_strict(line, layout)


@pytest.mark.parametrize(
    "line, reason",
    [
        ("2021-01-02,a,1,2", None),
        (' 2021-01-02 , a ,"1",', None),
        ('"2021-01-02","a,b","",".5e-3"', None),
        ('2021-01-02,"a""b",+1.,-2', None),
        ("2021-01-02,a,1e38,1e-99", None),
        ("0000-02-29,a,1,2", None),
        ("0001-02-29,a,1,2", "invalid date"),
        ("2021-1-2,a,1,2", "invalid date"),
        ("2021-02-30,a,1,2", "invalid date"),
        (",a,1,2", "invalid date"),
        ("2021-01-02, ,1,2", "empty channel"),
        ("2021-01-02,a,1", "too few fields"),
        ("2021-01-02,a,1,2,", "too many fields"),
        ('2021-01-02,a"b,1,2', "stray quote"),
        ('2021-01-02,"a,1,2', "unclosed quote"),
        ('2021-01-02,"a"b,1,2', "text after closing quote"),
        ("2021-01-02,a,NaN,2", "invalid deliver_qty"),
        ("2021-01-02,a,1,Infinity", "invalid return_qty"),
        ("2021-01-02,a,1.2.3,", "invalid deliver_qty"),
        ("2021-01-02,a,３,2", "invalid deliver_qty"),
        ("2021-01-02,a,1_0,2", "invalid deliver_qty"),
        ("2021-01-02,a,1e999,2", "invalid deliver_qty"),
        ("2021-01-02,a,1e39,2", "invalid deliver_qty"),  # not finite as float
        ("2021-01-02,a,1," + "9" * 50, "invalid return_qty"),
        ("", "too few fields"),
        (None, "no record"),
    ],
)
def test_records_both_ways(line, reason):
    """The strict parser, and the block that holds the record, agree."""
    assert strict(line)[1] == reason
    good = "2021-01-02,a,1,2"
    columns, reasons = badrows.parse_block(pa.array([good, line, good]), CSV)
    assert reasons.to_pylist() == [None, reason, None]
    assert [c.cast(pa.int32()).to_pylist()[1] if c.type == pa.date32() else c.to_pylist()[1] for c in columns] == strict(line)[0]


def test_bulk_never_accepts_more():
    rng = random.Random(3)
    pieces = ["2021-01-02", "2021-13-02", '"', ",", ",", ",", "a", '""', "1", ".", "e5", " ", "\n", "\r", "-", "+", "\t", "é", "x", "e39"]
    good = "2021-01-02,a,1,2"
    for _ in range(4000):
        line = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 10))) if rng.random() < 0.5 else good.replace(rng.choice("21a,-"), rng.choice(pieces), 1)
        columns, bad = badrows.parse_bulk(pa.array([good, line]), CSV)
        assert not bad[0]
        if not bad[1]:
            values, reason = strict(line)
            assert reason is None, line
            assert [c[1].as_py() for c in columns][1:] == values[1:], line


@given(st.lists(st.booleans(), max_size=80))
def test_halving(bad):
    clean, single = badrows.clean_stretches(np.array(bad, bool))
    assert single == [i for i, b in enumerate(bad) if b]
    assert [i for a, z in clean for i in range(a, z)] == [i for i, b in enumerate(bad) if not b]
    assert len(clean) <= len(single) + 1


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
def test_line_end_in_record(spark, end):
    good = "2021-01-02,a,1,2"
    assert badrows.parse_bulk(pa.array([good, good + end]), CSV)[1].tolist() == [False, True] and strict(good + end)[1] == "invalid return_qty"
    df = spark.createDataFrame([(i, "csv", good + end * (i == 50)) for i in range(200)], "line_id long, layout string, raw_line string").coalesce(1)
    assert [r["line_id"] for r in badrows.rejected_records(badrows.parse_records(df, "raw_line", "layout", problems.LAYOUTS, ("line_id",)), ("line_id",)).collect()] == [50]


def test_records_whole(spark):
    fwf = "2021-01-02" + "a".ljust(74) + "1.5".ljust(40) + "".ljust(40)
    rows = [(i, "f", 2, "csv", "2021-01-02,a,1,") for i in range(700)] + [(700, "f", 2, "csv", "x"), (701, "f", 2, "fwf", fwf), (702, "f", 2, "fwf", fwf[:-1]), (703, "f", 2, None, "y"), (704, "f", 2, "csv", None), (705, "f", 2, "csv", "2021-01-02," + "z" * 200_000 + ",1,1")]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, layout string, raw_line string").repartition(3)
    done = badrows.parse_records(df, "raw_line", "layout", problems.LAYOUTS, ("line_id",))
    bad = {r["line_id"]: r["reason"] for r in badrows.rejected_records(done, ("line_id",)).collect()}
    assert bad == {700: "too few fields", 702: "length is not 164", 703: "unknown layout", 704: "no record"}
    assert badrows.valid_records(done).count() == 702
    assert badrows.parse_records(df.limit(0), "raw_line", "layout", problems.LAYOUTS).collect() == []
    with pytest.raises(ValueError):
        badrows.parse_records(df.withColumnRenamed("line_id", "date"), "raw_line", "layout", problems.LAYOUTS, ("date",))


def test_strict_parses_are_few():
    """Only the records at fault, and the few in doubt, are parsed one by one."""
    rows = pq.read_table("/root/testdata/sf0.01/caven20_lines.parquet", columns=["raw_line", "layout", "line_no"]).to_pylist()
    asked, original = [], badrows.parse_strict
    badrows.parse_strict = lambda line, layout: asked.append(line) or original(line, layout)
    try:
        bad = 0
        for name, layout in problems.LAYOUTS.items():
            lines = [r["raw_line"] for r in rows if r["layout"] == name and not (name == "csv" and r["line_no"] == 1)]
            bad += len(lines) - badrows.parse_block(pa.array(lines, pa.string()), layout)[1].null_count
    finally:
        badrows.parse_strict = original
    assert 300 < bad <= len(asked) <= 1.5 * bad


def test_other_layout(spark):
    """Any number of fields, of any kind, filled or not."""
    fields = tuple(badrows.Field(*x) for x in (("id", "double", True), ("note", "text"), ("day", "date")))
    layouts = {"c": badrows.RecordLayout(fields), "w": badrows.RecordLayout(fields, ((0, 4), (4, 8), (8, 18)))}
    lines = [("c", "1e39,,"), ("c", ",x,"), ("c", '2,"a,b",2020-02-29'), ("w", " 7  no  2020-02-30"), ("w", " 7          " + " " * 6), ("c", "3,y,2020-02-30")]
    df = spark.createDataFrame(lines, "reason string, raw string")
    got = [tuple(r) for r in badrows.parse_records(df.coalesce(1), "raw", "reason", layouts).collect()]
    assert sorted(got, key=str) == sorted([(1e39, "", None, None), (None, None, None, "empty id"), (2.0, "a,b", D(2020, 2, 29), None), (None, None, None, "invalid day"), (7.0, "", None, None), (None, None, None, "invalid day")], key=str)
    with pytest.raises(ValueError):
        badrows.RecordLayout((badrows.Field("x", "blob"),))


def test_headers(spark):
    df = spark.createDataFrame([(1, "csv"), (1, "fwf"), (None, "csv"), (2, "csv")], "n int, l string")
    assert badrows.without_headers(df, "n", "l").count() == 3


# ---- profiles


def _table(spark, rows, path=None, group=60):
    schema = "load int, at timestamp, d date, q float, t string"
    if path is None:
        return spark.createDataFrame(rows, schema)
    kinds = pa.schema([("load", pa.int32()), ("at", pa.timestamp("us", "UTC")), ("d", pa.date32()), ("q", pa.float32()), ("t", pa.string())])
    columns = list(zip(*sorted(rows, key=lambda r: r[0])))
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), path, row_group_size=group)
    return spark.read.parquet(path)


def _loads(n_loads=12, size=60, odd=None):
    rng, rows = random.Random(4), []
    for load in range(n_loads):
        month = (2021 + load // 12, load % 12 + 1)
        at = dt.datetime(month[0] + (month[1] == 12), month[1] % 12 + 1, 2)
        for _ in range(size):
            q = float(rng.randrange(1, 50))
            rows.append([load, at, D(*month, rng.randrange(1, 28)), q, "ab"])
    if odd:
        for r in rows:
            odd(r, rng)
    return [tuple(r) for r in rows]


CALENDAR = [(D(2020, 12, 1) + dt.timedelta(days=i),) for i in range(800)]


def unlike(spark, df):
    """The cases, with the feed's own steps and rule for the month of a load."""
    calendar = spark.createDataFrame(CALENDAR, "date date")
    months = problems.load_months(df.withColumnsRenamed({"load": "load_id", "at": "loaded_at"}))
    return profile.unlike_loads(df, "load", ["q"], ["d"], months, problems.STEPS, days=problems.calendar_span(calendar)).collect()


@pytest.mark.parametrize("on_disk", [False, True])
def test_unlike_loads(spark, tmp_path, on_disk):
    def odd(r, rng):
        if r[0] == 3 and rng.random() < 0.4:
            r[3] = None
        if r[0] == 5:
            r[3] = 7.0
        if r[0] == 7 and rng.random() < 0.5:
            r[2] = D(1970, 1, 1)
        if r[0] == 9:
            r[3] *= 1000

    df = _table(spark, _loads(odd=odd), str(tmp_path / "t") if on_disk else None)
    got = {(r["load"], r["column_name"]) for r in unlike(spark, df)}
    assert got == {(3, "q"), (5, "q"), (7, "d"), (9, "q")}


def test_unlike_loads_edges(spark):
    plain = _table(spark, _loads())
    assert unlike(spark, plain) == []
    assert unlike(spark, plain.limit(0)) == []
    nulls = spark.createDataFrame([(i % 3, None, None, None, None) for i in range(30)] + [(None,) * 5], plain.schema)
    assert unlike(spark, nulls) == []


def test_unlike_loads_tenth(spark):
    """A case may touch as little as a tenth of a load's rows."""
    cases = {1: (0.1, lambda q: q * 1000), 3: (0.15, lambda q: q * 10), 5: (0.15, lambda q: q / 1000), 7: (0.1, lambda q: 9999.0), 9: (0.1, lambda q: None), 11: (0.12, lambda q: -q)}
    rng, rows = random.Random(5), []
    for load in range(16):
        at, size = dt.datetime(2021 + (load + 1) // 12, (load + 1) % 12 + 1, 2), 2500
        share, change = cases.get(load, (0, None))
        for i in range(size):
            q = float(round(rng.lognormvariate(4, 1.2)) + 1)
            rows.append((load, at, D(2021 + load // 12, load % 12 + 1, rng.randrange(1, 28)), change(q) if i < share * size else q, "ab"))
    got = {(r["load"], r["column_name"]): r["reasons"] for r in unlike(spark, _table(spark, rows))}
    assert set(got) == {(load, "q") for load in cases}
    assert "range" in got[1, "q"] and "range" in got[5, "q"] and "repeated" in got[7, "q"]


def test_profile_agrees_with_scan(spark, tmp_path):
    def odd(r, rng):
        if r[0] == 2:
            r[3] = None
        if r[0] == 4:
            r[3] = 7.0
        if r[0] == 6 and rng.random() < 0.3:
            r[4] = "wrong!"

    rows = _loads(odd=odd)
    on_disk = _table(spark, rows, str(tmp_path / "t"))
    args = ("load", ["q"], ["d"], {"t": "[a-z]+"})
    a, b = (sorted((tuple(r) for r in profile.column_profile(x, *args).collect()), key=str) for x in (on_disk, _table(spark, rows)))
    assert a == b
    filtered = on_disk.where("load < 3")
    assert {r["load"] for r in profile.column_profile(filtered, *args).collect()} == {0, 1, 2}
    # Only what the files do not tell is read: of loads 2 and 4 just the dates, of all texts those of load 6.
    plan = profile.chunk_plan(on_disk, "load", profile._Kinds(("q",), ("d",), {"t": "[a-z]+"}))
    needed = {r["row_group"]: set(r["needed"]) for r in plan.where("file IS NOT NULL").collect()}
    assert needed == {g: {"d"} if g in (2, 4) else {"d", "q", "t"} if g == 6 else {"d", "q"} for g in range(12)}
    assert sum(r["n"] for r in plan.where("class IS NOT NULL").collect()) == 2 * 60 + 11 * 60
    # Where all of a load is known, its rows are not read at all.
    spared = profile.chunk_plan(on_disk, "load", profile._Kinds(("q",), (), {"t": "[a-z]+"})).where("file IS NOT NULL")
    assert spared.agg(F.sum("n_rows")).first()[0] == 10 * 60 < on_disk.count()


@pytest.mark.parametrize("on_disk", [False, True])
def test_infinite_values(spark, tmp_path, on_disk):
    """An infinite quantity is one value with one cell, whichever way it is counted."""
    def odd(r, rng):
        if r[0] == 1:
            r[3] = math.inf
        if r[0] == 2 and rng.random() < 0.5:
            r[3] = -math.inf
        if r[0] == 3 and rng.random() < 0.5:
            r[3] = math.nan

    df = _table(spark, _loads(odd=odd), str(tmp_path / "t") if on_disk else None)
    counts = [tuple(r) for r in profile.column_counts(df, "load", ["q"]).where("part = 1 OR lo = double('-inf')").collect()]
    assert [c[:7] for c in counts if c[1] == 1] == [("q", 1, "positive", profile.INFINITE, 60, math.inf, math.inf)]
    assert [(c[2], c[3], c[5]) for c in counts if c[1] == 2] == [("negative", profile.INFINITE, -math.inf)]
    rows = {r["load"]: r for r in profile.column_profile(df, "load", ["q"]).collect()}
    assert rows[1]["highest"] == math.inf and rows[1]["n_distinct"] == 1 and rows[3]["nan_share"] > 0.3
    assert {(r["load"], r["column_name"]) for r in unlike(spark, df)} == {(1, "q"), (2, "q"), (3, "q")}


def test_sketches():
    """Exact up to their size, within a few percent beyond, and alike however they were put together."""
    rng = np.random.default_rng(1)
    for n in (0, 10, profile.DISTINCT - 1, 100_000, 3_000_000):
        h = profile._hashes(pa.array(rng.permutation(n)))
        parts = [profile.smallest(x) for x in np.array_split(np.concatenate([h, h[: n // 2]]), 7)]
        whole = profile.smallest(*parts)
        assert np.array_equal(whole, profile.smallest(h))
        assert profile.estimate(whole) == n if n < profile.DISTINCT else abs(profile.estimate(whole) - n) < 0.05 * n


def test_registered_distinct(spark):
    """All columns of caven20 per load, against exact counts."""
    db = database()
    columns = [r[0] for r in db.sql("DESCRIBE caven20").fetchall()]
    want = {(c, load): n for c in columns for load, n in db.sql(f"SELECT load_id, count(DISTINCT {c}) FROM caven20 GROUP BY 1").fetchall()}
    got = {(r["column"], r["load_id"]): r["n_distinct"] for r in problems.QUERIES["p3_distinct"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert got == want


def test_dictionary_pages(tmp_path):
    t = pa.table({"p": pa.array([1] * 6 + [2] * 4, pa.int32()), "v": pa.array([1.5, None, 2.5, 1.5, 1.5, 1.5, 9.0, 9.0, 9.0, 9.0], pa.float32()), "s": ["a", "b", "a", "a", "a", "a", "c", "c", "c", "c"]})
    for codec in ("snappy", "none", "zstd", "gzip"):
        path = tmp_path / f"{codec}.parquet"
        pq.write_table(t, path, row_group_size=6, compression=codec)
        got = {(k.group, k.column): k for k in chunks.chunks_of(f"file://{path}", "p", ["v", "s"], ["v", "s"])}
        assert sorted(got[0, "v"].dictionary) == [1.5, 2.5] and got[0, "v"].nulls == 1
        assert sorted(got[0, "s"].dictionary) == [b"a", b"b"] and list(got[1, "v"].dictionary) == [9.0]
    pq.write_table(t, tmp_path / "plain.parquet", use_dictionary=False)
    assert all(k.dictionary is None and k.part is None for k in chunks.chunks_of(f"file://{tmp_path}/plain.parquet", "p", ["v"], ["v"]))


@pytest.mark.parametrize("says", [True, False])
def test_dictionary_given_up(tmp_path, monkeypatch, says):
    """A chunk of any size; one whose later pages leave the dictionary is not known by it, by footer or by page headers."""
    if not says:
        monkeypatch.setattr(chunks, "page_encodings", lambda f: [[None] * 3] * 9)
    n = 200_000
    t = pa.table({"p": pa.array([1] * n, pa.int32()), "few": pa.array(np.arange(n) % 7, pa.int64()), "many": pa.array([f"text {i} " + "x" * 40 for i in range(n)])})
    pq.write_table(t, tmp_path / "t.parquet", dictionary_pagesize_limit=100_000, data_page_size=20_000)
    few, many = chunks.chunks_of(f"file://{tmp_path}/t.parquet", "p", ["few", "many"], ["few", "many"])
    assert sorted(few.dictionary) == list(range(7)) and many.dictionary is None
