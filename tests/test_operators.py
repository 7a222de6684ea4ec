"""Golden values and edge cases of the dataframe operators."""

import datetime as dt
import math
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.functions import calendars, hashes, scalars, vectors
from skeinworks.functions.curves import curve, curve_rows
from skeinworks.operators import columns, grouping, lookup, reshape, rows
from skeinworks.operators.rows import ROW
from skeinworks.sources import raster, records, text
from skeinworks.streaming import state

D = dt.date
# Four feed records: a date and a channel occur twice.
FEED = [
    (D(2017, 10, 13), "0101761/0101010207/13-14/01", 88.0, 0.0),
    (D(2017, 10, 22), "0102211/0101010212/13-14/01", 80.0, 0.0),
    (D(2017, 10, 24), "0500020/0101010106/13-14/05", 4.0, 0.0),
    (D(2017, 10, 22), "0500020/0101010106/13-14/05", 820.0, 0.0),
]


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(FEED)], f"{ROW} long, date date, channel string, delivered float, ret float")


def by_row(df):
    return [tuple(r)[:] for r in df.orderBy(ROW).collect()]


def test_fixed_width(spark, tmp_path):
    lines = [f"{d}{c:<74}{v:>40.12f}{'0E-12':>40}" for d, c, v, _ in FEED]
    (tmp_path / "f.fwf").write_text("\n".join(lines) + "\n")
    spec = [("date", 0, 10, "IoLocalDate"), ("channel", 10, 84, "IoString"), ("delivered", 84, 124, "IoFloat"), ("ret", 124, 164, "IoFloat")]
    got = sorted(tuple(r) for r in text.read_fixed_width(spark, str(tmp_path / "f.fwf"), spec).collect())
    assert got == sorted(FEED) and got[1][2] == 80.0
    (tmp_path / "u.fwf").write_text("éab\n")
    assert text.read_fixed_width(spark, str(tmp_path / "u.fwf"), [("x", 0, 2, "IoString"), ("y", 2, 4, "IoString")]).first() == ("é", "ab")


def test_resample(spark, feed):
    done = reshape.resample_daily(feed, "date")
    assert done.count() == 13 and done.where("channel IS NULL").count() == 9
    assert [r[1] for r in by_row(done)][:4] == [r[0] for r in FEED]
    sides = rows.positional_join(done.select(ROW, "date", "channel"), done.select(ROW, "delivered", "ret"))
    assert by_row(sides) == by_row(done.select(*sides.columns))
    assert reshape.resample_daily(feed.limit(0), "date").count() == 0


def test_pivot_group_sum(feed):
    wide = reshape.pivot_sparse(feed, ["date"], ["channel"], ["delivered", "ret"])
    assert len(wide.columns) == 1 + 3 * 2 + 1 and wide.columns[1] == f"[channel={FEED[0][1]}]:delivered"
    assert wide.count() == 4
    summed = reshape.pivot_sum(feed, ["date"], ["channel"], ["delivered"]).where("date = '2017-10-22'").first()
    assert sorted(summed[1:]) == [0.0, 80.0, 820.0]


def test_pivot_null_key(spark):
    df = spark.createDataFrame([(0, None, 1), (1, "a", 2)], f"{ROW} long, k string, v int")
    assert reshape.pivot_sparse(df, [], ["k"], ["v"]).columns == ["[k=null]:v", "[k=a]:v", ROW]


def test_group_nested_keeps_nulls(spark):
    df = spark.createDataFrame([(0, "b", None), (1, None, 2), (2, "b", 3), (3, None, None)], f"{ROW} long, k string, v int")
    assert [(r["k"], r["v"]) for r in grouping.group_nested(df, "k").orderBy(ROW).collect()] == [("b", [None, 3]), (None, [2, None])]
    fold = grouping.group_reduce(df, ["k"], lambda a, x: F.coalesce(a, F.lit(10)) - F.coalesce(x, F.lit(1)))
    assert {(r["k"], r["v"]) for r in fold.collect()} == {("b", 6), (None, 7)}


@pytest.mark.parametrize("bucket", [2, 3, 50])
def test_group_fold(spark, bucket):
    """Folded in stretches of any length, in row order; a key that holds most rows is never collected."""
    made = [(i, "hot" if i % 5 else None, None if i % 7 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(made, f"{ROW} long, k string, v int").repartition(5)
    joined = lambda a, b: F.coalesce(F.concat(a, F.lit(","), b), a, b)
    df = df.withColumn("v", F.col("v").cast("string"))
    got = {r["k"]: r["v"] for r in grouping.group_fold(df, ["k"], joined, joined, bucket_rows=bucket).collect()}
    assert got == {k: ",".join(str(v) for _, x, v in made if x == k and v is not None) for k in ("hot", None)}
    assert grouping.group_fold(df.limit(0), ["k"], joined, joined).count() == 0


def test_stream_state_goes(spark, tmp_path):
    """Late events find their place by time; a key not heard of for long is forgotten."""
    source, day = tmp_path / "in", dt.timedelta(days=1)
    start = dt.datetime(2021, 1, 1)
    batches = [[("a", 1.0, start), ("a", 3.0, start + 2 * day)], [("a", 2.0, start + day), ("b", 9.0, start + 3 * day)], [("b", 8.0, start + 90 * day)], [("c", 1.0, start + 91 * day)], [("a", 7.0, start + 92 * day)]]
    schema = "k string, v double, t timestamp"
    q = state.last_values(spark.readStream.schema(schema).parquet(str(source / "*")), "t", "k", "v", 3, late="2 days", idle_seconds=10 * 86_400).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i, rows_ in enumerate(batches):
            spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(source / str(i)))
            q.processAllAvailable()
    finally:
        q.stop()
    seen = [(r["k"], r["last_values"]) for r in spark.table("kept").collect()]
    assert ("a", [1.0, 2.0, 3.0]) in seen and ("a", [7.0]) in seen


def test_reduce_nested(spark):
    df = spark.createDataFrame([([5, 1, 2], 7), ([], 8), (None, 9)], "a array<int>, b int")
    assert [tuple(r) for r in grouping.reduce_nested(df, lambda x, y: x - y).orderBy("b").collect()] == [(2, 7), (None, 8), (None, 9)]


def test_rows(spark):
    df = spark.createDataFrame([(c,) for c in "dbace"], "k string").repartition(3)
    numbered = rows.with_row(df, "k")
    assert [(r["k"], r[ROW]) for r in numbered.orderBy("k").collect()] == list(zip("abcde", range(5)))
    assert [r["k"] for r in rows.pick_rows(numbered, [4, 0, 0, 9]).orderBy(ROW).collect()] == ["e", "a", "a"]
    assert [r["k"] for r in rows.reverse_rows(numbered).orderBy(ROW).collect()] == list("edcba")
    assert [tuple(r) for r in rows.pair_chunks(numbered, "k").orderBy("pair").collect()] == [(0, "a", "b"), (1, "c", "d")]
    assert [r["k"] for r in rows.cyclic_repeat(numbered, 7).orderBy(ROW).collect()] == list("abcdeab")
    assert rows.with_row(df.limit(0), "k").count() == 0
    assert [r["k"] for r in rows.last_rows(numbered, 3).orderBy(ROW).collect()] == list("cde")


def test_concat_and_zip(spark):
    a, b, c = (spark.createDataFrame([(i, i + at) for i in range(n)], f"{ROW} long, v int") for at, n in ((0, 3), (3, 0), (3, 7)))
    assert [tuple(r) for r in rows.concat_rows(a, b, c).orderBy(ROW).collect()] == [(i, i) for i in range(10)]
    assert rows.zip_rows(a, c).count() == 3 and rows.positional_join(c, a).count() == 7
    assert rows.positional_join(a, c, c).columns == [ROW, "v", "v_1", "v_2"]


def test_split(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], f"{ROW} long")
    assert [r[0] for r in rows.split_rows(df, 3).orderBy(ROW).select("part").collect()] == [0] * 4 + [1] * 4 + [2] * 4
    assert spark.range(1).select(vectors.vsplit(F.sequence(F.lit(0), F.lit(10)), 3)).first()[0] == [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9, 10]]


@pytest.mark.parametrize("view, n, want", [(100, 5000, [0, 1, 2, 3, 7, 13, 20, 28, 37, 47, 59, 72]), (20, 3_000_000, [0, 9245, 36932, 82888, 146828, 228359])])
def test_horizon(spark, view, n, want):
    df = spark.range(n).withColumnRenamed("id", ROW)
    got = [r["source_row"] for r in rows.horizon_rows(df, view).orderBy(ROW).collect()]
    assert got[: len(want)] == want
    if view == 100:
        assert got[99] == 4919


def test_order(spark):
    df = spark.createDataFrame([(0, 9), (1, 10), (2, None), (3, 9)], f"{ROW} long, v int")
    assert [r["v"] for r in rows.ordered_text(df, "v").orderBy(ROW).collect()] == [10, 9, 9, None]
    assert [r["v"] for r in rows.ordered(df, "v").orderBy(ROW).collect()] == [None, 9, 9, 10]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert columns.mirror(df).columns == ["c", "b", "a"] and columns.drop_named(df, "b").columns == ["a", "c"]
    with pytest.raises(KeyError):
        columns.drop_named(df, "nope")
    assert columns.select_at(df, 2, 0, 2).columns == ["c", "a", "c_1"]
    bad = spark.createDataFrame([(None, float("inf"), [float("nan"), 1.0])], "a int, b float, c array<double>")
    assert columns.fill_missing(bad, 5.0).first() == (5, 5.0, [5.0, 1.0])
    with pytest.raises(Exception, match="no such key"):
        spark.range(1).select(columns.gather_map(F.create_map(F.lit("a"), F.lit(1)), F.array(F.lit("b")))).collect()


def test_one_hot(spark):
    df = spark.createDataFrame([(0, "b", 1), (1, "a", 1), (2, None, 1)], f"{ROW} long, s string, n int")
    assert reshape.one_hot(df, ["s", "n"]).columns == [ROW, "s=a", "s=b", "n=1"]
    assert reshape.one_hot(df, ["s"], "s=a").columns == [ROW, "s=null", "s=b"]
    assert reshape.one_hot(df, ["s"], "none").count() == 3


def test_scaling(spark):
    df = spark.createDataFrame([(10, "a"), (100, "b"), (None, "c")], "v int, k string")
    done = reshape.normalize(df, "v")
    assert [tuple(r) for r in done.orderBy("k").collect()] == [("a", 0.0), ("b", 1.0), ("c", None)]
    assert [r["v"] for r in reshape.denormalize(done, "v").orderBy("k").collect()] == [10.0, 100.0, None]
    assert math.isnan(reshape.normalize(df.where("v = 10"), "v").first()[1])
    assert reshape.normalize(df.limit(0), "v").count() == 0
    assert grouping.value_range(spark.createDataFrame([(-3.0,), (-1.0,)], "v double"), "v").first() == (-3.0, -1.0)


def test_hashes():
    assert hashes.md4(b"test") == "db346d691d7acc4dc2625db19f9e3f52" and hashes.md4(b"1") == "8be1ec697b14ad3a53b371436120641d"
    # The digests of the standard's own examples.
    examples = {"": "31d6cfe0d16ae931b73c59d7e0c089c0", "a": "bde52cb31de33e46245e05fbdbd6fb24", "abc": "a448017aaf21d8525fc10ae87aa6729d", "message digest": "d9130a8164549fe818874806e1c7014b"}
    assert hashes.md4_many([x.encode() for x in examples]) == list(examples.values())
    assert hashes.md4(b"") == "31d6cfe0d16ae931b73c59d7e0c089c0" and len({hashes.md4(b"a" * n) for n in range(130)}) == 130


@settings(max_examples=64, deadline=None)
@given(st.integers(1, 24), st.integers(1, 24))
def test_curve(w, h):
    cells = list(curve(w, h))
    assert sorted(cells) == [(x, y) for x in range(w) for y in range(h)]
    assert all((a - c) ** 2 + (b - e) ** 2 <= 2 for (a, b), (c, e) in zip(cells, cells[1:]))


@pytest.mark.parametrize("w, h", [(1, 1), (2, 19), (7, 8), (31, 18), (40, 33)])
def test_curve_rows(spark, w, h):
    assert [(r["x"], r["y"]) for r in curve_rows(spark, w, h).orderBy("pos").collect()] == list(curve(w, h))


def test_trie(spark):
    df = spark.createDataFrame([(0, ["up", "left", "far"]), (1, ["up", "left"]), (2, ["up", "left", "near", "by"]), (3, ["down"])], f"{ROW} long, path array<string>")
    assert {tuple(r["path"]) for r in lookup.trie_leaves(df).collect()} == {("up", "left", "far"), ("up", "left", "near", "by"), ("down",)}
    assert lookup.trie_find(df, ["up", "left"]).count() == 1 and lookup.trie_prefix(df, ["up", "left"]).count() == 3


def test_bloom(spark):
    bloom = lookup.bloom_filter(spark.range(20_000), "id", 20_000)
    asked = lambda b, df: df.where(b.may_contain(F.col("id"))).count()
    assert asked(bloom, spark.range(20_000)) == 20_000
    assert asked(bloom, spark.range(100_000, 200_000)) / 100_000 <= 1.10 * math.exp(-(math.log(2) ** 2) * 11) + 0.002
    both = bloom.merged(lookup.bloom_filter(spark.range(50_000, 50_010), "id", 20_000))
    assert asked(both, spark.range(20_000)) == 20_000 and asked(both, spark.range(50_000, 50_010)) == 10
    with pytest.raises(ValueError):
        bloom.merged(lookup.bloom_filter(spark.range(10), "id", 10))
    with pytest.raises(ValueError):
        lookup.bloom_filter(spark.range(10), "id", lookup.MOST_BITS)


def test_bloom_semi_join(spark, monkeypatch):
    left = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(1000)], "k int, v int")
    right = spark.createDataFrame([(i,) for i in (3, 3, 7, 99)] + [(None,)], "k int")
    want = sorted(tuple(r) for r in left.where("k IN (3, 7)").collect())
    joined = lookup.bloom_semi_join(left, right, "k")
    assert "might_contain" in joined._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in joined.collect()) == want
    assert lookup.bloom_semi_join(left, right.limit(0), "k").count() == 0
    monkeypatch.setattr(lookup, "MOST_BITS", 4)  # too many keys for a filter: joined without one
    assert sorted(tuple(r) for r in lookup.bloom_semi_join(left, right, "k").collect()) == want


def test_cluster_blooms(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(100)], f"{ROW} long, k string, v int")
    blooms = lookup.cluster_blooms(df, "k", "v")
    assert df.join(blooms, "k").where(lookup.in_cluster_bloom(F.col("bloom"), F.col("v"))).count() == 100
    other = df.withColumn("k", F.when(F.col("k") == "a", "b").otherwise("a"))
    assert other.join(blooms, "k").where(lookup.in_cluster_bloom(F.col("bloom"), F.col("v"))).count() < 5


def test_calendars(spark):
    df = spark.createDataFrame([(D(2017, 10, 13),)], "d date")
    assert calendars.calendar_features(df, "d", "Iso").first() == (5, 13, 2, 10, 2017)
    assert calendars.calendar_features(df, "d", "ThaiBuddhist").first()[4] == 2560
    assert calendars.calendar_features(df, "d", "Minguo").first()[4] == 106
    h = calendars.calendar_features(df, "d", "Hijrah").first()
    assert (h["Hijrah:YEAR"], h["Hijrah:MONTH_OF_YEAR"], h["Hijrah:DAY_OF_MONTH"], h["Hijrah:DAY_OF_WEEK"], h["Hijrah:ALIGNED_WEEK_OF_MONTH"]) == (1439, 1, 23, 5, 4)
    days = spark.createDataFrame([(D(2022, 7, 30) + dt.timedelta(days=97 * i),) for i in range(60)] + [(None,), (D(1800, 1, 1),), (D(9999, 1, 1),)], "d date")
    of = spark._jvm.java.time.chrono.HijrahDate
    field = spark._jvm.java.time.temporal.ChronoField
    for r in calendars.calendar_features(days, "d", "Hijrah", keep=("d",)).collect():
        if r["d"] is None or not 1882 < r["d"].year < 2174:
            assert tuple(r)[1:] == (None,) * 5
        else:
            jvm = getattr(of, "from")(spark._jvm.java.time.LocalDate.parse(str(r["d"])))
            assert list(r)[1:] == [int(jvm.getLong(field.valueOf(n))) for n in calendars.FIELDS]
    same = spark.range(1).select(calendars.day_sequence(F.lit(D(2020, 1, 1)), F.lit(D(2020, 1, 1))), calendars.day_sequence(F.lit(D(2020, 1, 1)), F.lit(D(2020, 1, 3)))).first()
    assert same[0] == [] and same[1] == [D(2020, 1, 1), D(2020, 1, 2)]


def test_scalars(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("Infinity",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.to_double(F.col("t"), -1.0)).collect()] == [1.5, -1.0, -1.0, -1.0]
    assert df.select(scalars.to_float_low(F.col("t"))).collect()[1][0] == float("-inf")
    assert scalars.fibonacci(10) == 55


def test_records_round_trip(spark, tmp_path):
    at = dt.datetime(2021, 5, 6, 7, 8, 9, 123456, dt.timezone.utc)
    made = [(i, True, i % 5, i * 10, i / 2, i / 4, f"té{i}", D(2021, 1, 1) + dt.timedelta(days=i), at) for i in range(300)]
    df = spark.createDataFrame(made, f"{ROW} long, b boolean, i int, l long, f float, d double, s string, day date, t timestamp").repartition(4)
    path = str(tmp_path / "r")
    layout = records.write_records(df, path, widths={"s": 12})
    assert layout.length == 1 + 4 + 8 + 4 + 8 + 12 + 8 + 12
    back = records.read_records(spark, path)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert records.read_records(spark, path, ["s"]).columns == ["s", ROW]
    exact = records.read_records(spark, path, ["t"], exact_instants=True).first()["t"]
    assert tuple(exact) == (int(at.timestamp()), 123_456_000)
    with pytest.raises(FileExistsError):
        records.write_records(df, path)


def test_records_refuse(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        records.write_records(spark.createDataFrame([("toolong",)], "s string"), str(tmp_path / "a"), text_width=3)
    with pytest.raises(Exception, match="can't store null"):
        records.write_records(spark.createDataFrame([(None,)], "i int"), str(tmp_path / "b"))
    records.write_records(spark.createDataFrame([(None, None)], "f float, s string"), str(tmp_path / "c"))
    r = records.read_records(spark, str(tmp_path / "c")).first()
    assert math.isnan(r["f"]) and r["s"] == ""


def test_records_are_not_broadcast(spark, tmp_path):
    """Whatever is read from records counts by its rows, not by the few bytes that list the files."""
    df = spark.range(40_000).select("id", F.concat(F.lit("text "), "id").alias("s"), F.col("id").alias(ROW))
    records.write_sharded(df, str(tmp_path / "r"), text_width=16)
    named = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.maxBroadcastTableSize": "128k"}
    was = {k: spark.conf.get(k) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        ids, texts = (records.read_records(spark, str(tmp_path / "r" / c)) for c in ("id", "s"))
        for back in (records.read_sharded(spark, str(tmp_path / "r"), ["id", "s"]), ids.join(texts, ROW)):
            assert back.columns == [ROW, "id", "s"]
            assert sorted(map(tuple, back.collect())) == [(i, i, f"text {i}") for i in range(40_000)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_sharded_files_differ(spark, tmp_path, monkeypatch):
    """Columns whose files end at different rows, or whose last record is cut off, as far as the shortest goes."""
    for c, sizes, kind in (("a", (3, 0, 4, 5), "i"), ("b", (7, 6), "q"), ("s", (1, 11), "4s")):
        layout, at = records.Layout(((c, {"i": "IoInt", "q": "IoLong", "4s": "IoString"}[kind], 0, struct.calcsize(f">{kind}")),)), 0
        (tmp_path / c).mkdir()
        (tmp_path / c / "table.meta").write_text(layout.text())
        for k, n in enumerate(sizes):
            (tmp_path / c / f"part-{k}.bin").write_bytes(b"".join(struct.pack(f">{kind}", f"t{i}".encode().ljust(4) if kind == "4s" else i) for i in range(at, at + n)) + b"cut"[: k % 2 * 3])
            at += n
    for split in (1, 50, 64 << 20):
        monkeypatch.setattr(records, "SPLIT_BYTES", split)
        back = records.read_sharded(spark, str(tmp_path), ["a", "b", "s"])
        assert back.columns == [ROW, "a", "b", "s"]
        assert by_row(back) == [(i, i, i, f"t{i}") for i in range(12)]
        assert by_row(records.read_records(spark, str(tmp_path / "a"))) == [(i, i) for i in range(12)]
    assert records.read_sharded(spark, str(tmp_path), ["a"]).columns == ["a", ROW]
    records.write_sharded(spark.createDataFrame([], f"i int, l long, {ROW} long"), str(tmp_path / "none"))
    assert records.read_sharded(spark, str(tmp_path / "none"), ["i", "l"]).collect() == []


def test_duplicate_names(spark, tmp_path):
    layout = records.Layout((("a", "IoInt", 0, 4), ("a", "IoInt", 4, 8)))
    (tmp_path / "x.bin").write_bytes(struct.pack(">iiii", 1, 2, 3, 4) + b"cut")
    (tmp_path / "x.bin.meta").write_text(layout.text())
    assert [tuple(r) for r in records.read_records(spark, str(tmp_path / "x.bin")).orderBy(ROW).collect()] == [(1, 2, 0), (3, 4, 1)]
    (tmp_path / "bare.bin").write_bytes(struct.pack(">iiii", 1, 2, 3, 4))
    own = records.Layout((("n", "IoLong", 0, 8),))
    assert [tuple(r) for r in records.read_records(spark, f"file://{tmp_path}/bare.bin", layout=own).orderBy(ROW).collect()] == [((1 << 32) + 2, 0), ((3 << 32) + 4, 1)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a, b ,c\n1 , x,2021-01-30\nbad,y,z,more\n")
    got = [tuple(r) for r in text.read_csv_lines(spark, str(tmp_path / "a.csv"), {"a": "IoInt", "c": "IoLocalDate"}).collect()]
    assert got == [(1, "x", D(2021, 1, 30)), (0, "y", D(1970, 1, 1))]
    df = spark.createDataFrame([(0, 0, True, None, 1.5), (1, 3, False, "t", 0.0)], f"{ROW} long, i int, b boolean, s string, d double")
    text.write_csv_lines(df, str(tmp_path / "out"), single_file=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["i,b,s,d", ",1,null,1.5", "3,,t,"]


def test_csv_headers(spark, tmp_path):
    """Only the first line of each file is its header, however often its text stands below."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text('a,b\n1,2\na,b\n"3, 4"\n')
    (tmp_path / "in" / "2.csv").write_text("a,b\n 5,6 \n")
    got = sorted(tuple(r) for r in text.read_csv_lines(spark, str(tmp_path / "in")).collect())
    assert got == [('"3', '4"'), ("1", "2"), ("5", "6"), ("a", "b")]
    (tmp_path / "in" / "3.csv").write_text("b,a\n7,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        text.read_csv_lines(spark, str(tmp_path / "in")).collect()
    empty = spark.createDataFrame([], "x int, y string")
    text.write_csv_lines(empty, str(tmp_path / "empty"), single_file=True)
    assert text.read_csv_lines(spark, str(tmp_path / "empty")).columns == ["x", "y"] and text.read_csv_lines(spark, str(tmp_path / "empty")).count() == 0
    odd = spark.createDataFrame([(0, ' a "q" \\ b', "\u20ac"), (1, None, "")], f"{ROW} long, x string, y string")
    text.write_csv_lines(odd, str(tmp_path / "odd"), single_file=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "odd")).collect()] == ["x,y", ' a "q" \\ b,\u20ac', "null,"]


def test_raster(spark, tmp_path):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(bytes([how]) + bytes(row) for how, row in ((0, [0, 255, 10]), (1, [1, 1, 1]), (2, [1, 1, 1]), (4, [1, 1, 1]), (3, [2, 2, 2])))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    (tmp_path / "p.png").write_bytes(png)
    got = [[round(v * 255) for v in r["pixels"]] for r in raster.read_gray(spark, str(tmp_path / "p.png")).orderBy(ROW).collect()]
    assert got[:3] == [[0, 255, 10], [1, 2, 3], [2, 3, 4]] and got[3] == [3, 4, 5] and got[4] == [3, 5, 7]


def test_digest_and_xpath(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert text.file_digests(spark, str(tmp_path)).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    page = spark.createDataFrame([("<t><td>a</td><td>b</td></t>",)], "h string")
    assert page.select(text.xpath_list(F.col("h"), "//td/text()")).first()[0] == ["a", "b"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", float(i), dt.datetime(2021, 1, 1 + i // 4)) for i in range(-1, 7) if i >= 0], "k string, v double, t timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k string, v double, t timestamp").parquet(source)
    q = state.last_values(stream, "t", "k", "v", 3).writeStream.outputMode("update").format("memory").queryName("ring").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ring").first() == ("a", [4.0, 5.0, 6.0])
    q = state.daily_totals(stream, "t", "k", "v").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r["day"]), r["total"], r["n_rows"]) for r in spark.table("days").collect()) == [("2021-01-01", 6.0, 4), ("2021-01-02", 15.0, 3)]
