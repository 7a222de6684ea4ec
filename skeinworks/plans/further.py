"""Registered queries of sources, cell functions and vectors that the other modules do not show, with their SQL."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyarrow.fs import FileSystem
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import calendars, scalars, vectors
from skeinworks.operators import columns, grouping, lookup, regular, reshape, rows
from skeinworks.operators.rows import ROW
from skeinworks.session import read_table, shared_folder
from skeinworks.sources import raster, records, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def _write(spark: SparkSession, name: str, data: bytes) -> str:
    """A small file of the driver's in the shared folder."""
    uri = records.located(spark, f"{shared_folder(spark)}/file-{uuid.uuid4().hex}/{name}")
    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)
    return uri


# ---- sources


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS FLOAT) AS region, row_number() OVER (ORDER BY n_nationkey) - 1 AS row FROM nation")
def binary_scan(spark, d):
    """Records of known bytes, by a layout that the caller gives."""
    made = b"".join(struct.pack(">i12sf", r["n_nationkey"], r["n_name"].encode().ljust(12), r["n_regionkey"]) for r in read_table(spark, d, "nation").orderBy("n_nationkey").collect())
    layout = records.Layout((("n_nationkey", "IoInt", 0, 4), ("n_name", "IoString", 4, 16), ("region", "IoFloat", 16, 20)))
    return records.read_records(spark, _write(spark, "nation.bin", made), layout=layout).withColumnRenamed(ROW, "row")


@query("SELECT * FROM (VALUES (DATE '2017-10-13', 'a/1', 88.0, 0.0), (DATE '2017-10-22', 'b/2', 80.5, NULL), (NULL, 'c', 4.0, 1.0)) t(date, channel, delivered, ret)")
def heap_rows(spark, d):
    """A table of values in the program."""
    from datetime import date

    return spark.createDataFrame([(date(2017, 10, 13), "a/1", 88.0, 0.0), (date(2017, 10, 22), "b/2", 80.5, None), (None, "c", 4.0, 1.0)], "date date, channel string, delivered double, ret double")


@query("SELECT i, i * i AS square FROM range(0, 1000) t(i)")
def enumerated(spark, d):
    return spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("square"))


@query("SELECT y AS row, array_to_string(list_transform(range(0, 5), lambda x: (x * 40 + y * 7) % 256), ',') AS pixels FROM range(0, 4) t(y)")
def gray_raster(spark, d):
    """A picture of 4 lines of 5 pixels, written with the filters none, left, up and average."""
    lines = [[(x * 40 + y * 7) % 256 for x in range(5)] for y in range(4)]
    above, body = [0] * 5, b""
    for how, line in zip((0, 1, 2, 3), lines):
        left = [0, *line[:-1]]
        guess = ([0] * 5, left, above, [(a + b) // 2 for a, b in zip(left, above)])[how]
        body += bytes([how, *((v - g) % 256 for v, g in zip(line, guess))])
        above = line

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    read = raster.read_gray(spark, _write(spark, "p.png", png))
    return read.select(F.col(ROW).alias("row"), F.array_join(F.transform("pixels", lambda v: F.round(v * 255).cast("int").cast("string")), ",").alias("pixels"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def xpath_names(spark, d):
    """The cells of a page of each region, by XPath."""
    rows_ = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    page = F.concat(F.lit("<html><table>"), F.array_join(F.transform(rows_, lambda r: F.concat(F.lit("<tr><td>"), r["n_nationkey"].cast("string"), F.lit("</td><td>"), r["n_name"], F.lit("</td></tr>"))), ""), F.lit("</table></html>"))
    pages = read_table(spark, d, "nation").groupBy("n_regionkey").agg(page.alias("html"))
    return pages.select("n_regionkey", F.array_join(text.xpath_list(F.col("html"), "//tr/td[2]/text()"), ";").alias("names"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"twice\":[' || r_regionkey || ',' || 2 * r_regionkey || ']}' AS line FROM region")
def row_texts(spark, d):
    r = read_table(spark, d, "region").select("r_regionkey", "r_name", F.array("r_regionkey", F.col("r_regionkey") * 2).alias("twice"))
    return r.select(text.row_text(r).alias("line"))


@query("SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region")
def volume_digest(spark, d):
    made = "".join(r["r_name"] + "\n" for r in read_table(spark, d, "region").orderBy("r_regionkey").collect()).encode()
    return text.file_digests(spark, _write(spark, "names.txt", made)).select("sha256")


@query("SELECT '[' || c_custkey || ', ' || chr(39) || c_name || chr(39) || ']' AS line FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5) UNION ALL SELECT 'rows: 5 [''c_custkey'', ''c_name'']'")
def console_head(spark, d):
    c = rows.with_row(read_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return spark.createDataFrame([(line,) for line in rows.as_lines(rows.first_rows(c, 5))], "line string")


@query("SELECT 5 AS n_rows, true AS all_there")
def console_random(spark, d):
    c = rows.with_row(read_table(spark, d, "customer").select("c_custkey"), "c_custkey")
    some = rows.sample_rows(c, 5)
    return some.join(c.select(F.col("c_custkey").alias("k")).distinct(), F.col("c_custkey") == F.col("k"), "left").agg(F.count_distinct("c_custkey").cast("int").alias("n_rows"), F.every(F.col("k").isNotNull()).alias("all_there"))


# ---- cells


@query("SELECT p_partkey, round((p_retailprice - 10) / 90, 6) AS scaled, round((p_retailprice - 10) / 90 * 180 + 20, 4) AS other FROM part")
def scalar_scaling(spark, d):
    scaled = reshape.scale(F.col("p_retailprice"), 10.0, 100.0)
    return read_table(spark, d, "part").select("p_partkey", F.round(scaled, 6).alias("scaled"), F.round(reshape.unscale(scaled, 20.0, 200.0), 4).alias("other"))


@query("SELECT min(CAST(o_orderdate AS DATE)) AS day_min, max(CAST(o_orderdate AS DATE)) AS day_max FROM orders")
def date_range(spark, d):
    return grouping.value_range(read_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


@query("SELECT n_nationkey, rpad(n_name, 14, ' ') || '|' AS padded, n_name AS back, octet_length(encode(n_name || 'é')) AS n_bytes FROM nation")
def text_steps(spark, d):
    n = read_table(spark, d, "nation")
    wide = scalars.padded(F.col("n_name"), 14)
    return n.select("n_nationkey", F.concat(wide, F.lit("|")).alias("padded"), F.trim(F.decode(F.encode(wide, "UTF-8"), "UTF-8")).alias("back"), F.octet_length(F.encode(F.concat("n_name", F.lit("é")), "UTF-8")).cast("long").alias("n_bytes"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS fib FROM part")
def chosen_and_fibonacci(spark, d):
    series = F.array(*[F.lit(scalars.fibonacci(i)) for i in range(5)])
    return read_table(spark, d, "part").select("p_partkey", scalars.choose(F.col("p_size") > 25, F.col("p_size")).alias("big"), F.get(series, (F.col("p_partkey") % 5).cast("int")).alias("fib"))


@query("SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def spans(spark, d):
    ends = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    return ends.select("o_custkey", F.round(scalars.span(F.col("a"), F.col("b")), 2).alias("spread"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', ts) END AS at FROM events")
def lenient_instants(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, "at noon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return read_table(spark, d, "events").select("event_id", calendars.lenient_instant(t).cast("timestamp_ntz").alias("at"))


@query("SELECT c_custkey, upper(c_name) || '!' AS c_name FROM customer WHERE c_custkey > 10")
def composed_steps(spark, d):
    steps = rows.compose(lambda t: t.where("c_custkey > 10"), lambda t: columns.select_named(t, "c_custkey", "c_name"), lambda t: t.withColumn("c_name", F.concat(F.upper("c_name"), F.lit("!"))))
    return steps(read_table(spark, d, "customer"))


@query("SELECT o_orderkey, list_extract(map_extract(MAP {5: 'e', 9: 'z', 7: 'g'}, o_orderkey % 10), 1) AS found, list_contains([5, 7, 9], o_orderkey % 10) AS there, '5,7,9' AS keys FROM orders")
def sorted_map_lookup(spark, d):
    m = lookup.sorted_map(vectors.vector(9, 5, 9, 7), vectors.vector("i", "e", "z", "g"))
    key = (F.col("o_orderkey") % 10).cast("int")
    return read_table(spark, d, "orders").select("o_orderkey", F.try_element_at(m, key).alias("found"), F.map_contains_key(m, key).alias("there"), F.array_join(F.map_keys(m).cast("array<string>"), ",").alias("keys"))


# ---- vectors

_E = "embeddings"


def _vectors(spark, d):
    """Whole thousandths of the embeddings, so that SQL and Spark write them alike."""
    return read_table(spark, d, _E).select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))


_V = f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v FROM {_E})"


def _text(a):
    return F.array_join(a.cast("array<string>"), ",")


@query(f"WITH {_V} SELECT vec_id, array_to_string(list_transform(v, lambda x: 2 * x + 1), ',') AS mapped, array_to_string(list_transform(v, lambda x, i: x * (i - 1)), ',') AS indexed, list_sum(list_transform(v, lambda x: abs(x))) AS total FROM v")
def vector_maps(spark, d):
    v = _vectors(spark, d)
    total = F.aggregate(vectors.vmap(F.col("v"), F.abs), F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("vec_id", _text(vectors.vmap(F.col("v"), lambda x: 2 * x + 1)).alias("mapped"), _text(vectors.vmap_indexed(F.col("v"), lambda x, i: x * i)).alias("indexed"), total.alias("total"))


@query(f"WITH {_V} SELECT vec_id, v[8] || ',' || v[1] || ',' || v[8] AS picked, v[1] || ',' || v[2] || ';' || v[3] || ',' || v[4] AS parts, array_to_string(list_concat(v[1:2], v[5:6], [7]), ',') AS joined FROM v")
def vector_gather(spark, d):
    v, a = _vectors(spark, d), F.col("v")
    picked = F.array_join(vectors.vgather(a, vectors.vector(7, 0, 7)).cast("array<string>"), ",")
    split = vectors.vsplit(vectors.vslice(a, 0, 4), 2)
    parts = F.array_join(F.transform(split, lambda x: F.array_join(x.cast("array<string>"), ",")), ";")
    joined = vectors.vappend(vectors.vconcat(vectors.vslice(a, 0, 2), vectors.vslice(a, 4, 6)), F.lit(7).cast("long"))
    return v.select("vec_id", picked.alias("picked"), parts.alias("parts"), _text(joined).alias("joined"))


@query(f"WITH {_V} SELECT vec_id, (v[1] + v[4]) || ',' || v[2] || '+' || v[3] || '+' AS left_size, 2 AS n_short, v[1] || ':' || v[4] AS first_pair FROM v")
def vector_zips(spark, d):
    """Combined by index: as many as the left has, or as the shorter has."""
    v, a = _vectors(spark, d), F.col("v")
    left, right = vectors.vslice(a, 0, 3), vectors.vslice(a, 3, 4)
    combined = vectors.vzip_with(left, right, lambda x, y: F.coalesce((x + y).cast("string"), F.concat(x.cast("string"), F.lit("+"))))
    pairs = vectors.vzip(vectors.vslice(a, 0, 2), vectors.vslice(a, 3, 6))
    first = F.concat(F.get(pairs, F.lit(0))["a"].cast("string"), F.lit(":"), F.get(pairs, F.lit(0))["b"].cast("string"))
    joined = F.concat(F.get(combined, F.lit(0)), F.lit(","), F.get(combined, F.lit(1)), F.get(combined, F.lit(2)))
    return v.select("vec_id", joined.alias("left_size"), F.size(pairs).alias("n_short"), first.alias("first_pair"))


@query(f"WITH {_V} SELECT vec_id, array_to_string(v[1:6], ',') AS flat, v[5] AS cell, v[4] AS inner_cell FROM v")
def vector_matrix(spark, d):
    """Six elements as a nested matrix of 2 x 3 and of 2 x 3 x 1, element by index, and flat again."""
    v, a = _vectors(spark, d), F.col("v")
    matrix = vectors.vsplit(vectors.vslice(a, 0, 6), 2)
    deep = F.transform(matrix, lambda r: F.transform(r, lambda x: F.array(x)))
    return v.select("vec_id", _text(vectors.vflatten(vectors.vflatten(deep))).alias("flat"), vectors.matrix_at(matrix, 1, 1).alias("cell"), vectors.matrix_at(deep, 1, 0, 0).alias("inner_cell"))


@query(f"WITH {_V} SELECT vec_id, v[1] || ',' || v[3] AS lefts, v[2] || ',' || v[4] AS rights, v[2] || '/' || v[1] AS turned, (-v[1]) || '/' || (-v[2]) AS signs, v[4] AS of_third FROM v WHERE v[1] <> v[3]")
def vector_parts(spark, d):
    """Pairs: their left and right sides, turned round, with other signs, and as a map."""
    v, a = _vectors(spark, d).where("v[0] <> v[2]"), F.col("v")
    pairs = vectors.vpairs(vectors.vslice(a, 0, 4))
    one = vectors.tuple_of(F.get(a, F.lit(0)), F.get(a, F.lit(1)))
    both = lambda p: F.concat(p["a"].cast("string"), F.lit("/"), p["b"].cast("string"))
    third = F.try_element_at(vectors.to_map(pairs), F.get(a, F.lit(2)))
    return v.select("vec_id", _text(vectors.left(pairs)).alias("lefts"), _text(vectors.right(pairs)).alias("rights"), both(vectors.swapped(one)).alias("turned"), both(vectors.negated(one)).alias("signs"), third.alias("of_third"))


@query("SELECT n_nationkey, array_to_string(string_split(n_name, ''), '-') AS letters, 1 + n_regionkey AS of_map, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '0,1' ELSE '2' END AS bits, '3,1,2' AS as_set FROM nation")
def vector_conversions(spark, d):
    """Texts, numbers and repeated values as arrays, maps and sets."""
    n = read_table(spark, d, "nation")
    of_map = F.element_at(vectors.mapping(one=F.lit(1) + F.col("n_regionkey"), two=2), F.lit("one"))
    return n.select("n_nationkey", F.array_join(vectors.letters(F.col("n_name")), "-").alias("letters"), of_map.alias("of_map"), _text(vectors.bit_places(F.col("n_regionkey"))).alias("bits"), _text(vectors.as_set(vectors.vector(3, 1, 3, 2, 1))).alias("as_set"))


# ---- readings with a time of day

_CELL, _HOLD = 6 * 3600, 24 * 3600


@query(f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS t, avg(value) AS v, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    i AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), (t // {_CELL * 1_000_000} + 1) * {_CELL * 1_000_000}) AS z FROM r),
    h AS (SELECT *, least(z, t + {_HOLD * 1_000_000}) AS b FROM i),
    c AS (SELECT *, unnest(generate_series(t // {_CELL * 1_000_000}, (z - 1) // {_CELL * 1_000_000})) AS cell FROM h),
    p AS (SELECT *, greatest(0, least(b, (cell + 1) * {_CELL * 1_000_000}) - greatest(t, cell * {_CELL * 1_000_000})) AS held, least(z, (cell + 1) * {_CELL * 1_000_000}) - greatest(t, cell * {_CELL * 1_000_000}) AS lasts FROM c)
    SELECT user_id, make_timestamp(cell * {_CELL * 1_000_000}) AS cell_start, CAST(sum(CASE WHEN t // {_CELL * 1_000_000} = cell THEN n ELSE 0 END) AS BIGINT) AS n_rows,
    round(sum(v * held) / nullif(sum(held), 0), 4) AS value, round(sum(held) / sum(lasts), 6) AS coverage,
    CASE WHEN sum(CASE WHEN t // {_CELL * 1_000_000} = cell THEN n ELSE 0 END) > 0 THEN 'observed' WHEN sum(held) > 0 THEN 'filled' ELSE 'missing' END AS state FROM p GROUP BY user_id, cell""")
def events_regular_six_hours(spark, d):
    """Events as a step function in time: cells of six hours, a value held for a day."""
    done = regular.regular_series_in_time(read_table(spark, d, "events"), "user_id", "ts", "value", cell_seconds=_CELL, hold_seconds=_HOLD)
    return done.select("user_id", F.col("cell_start").cast("timestamp_ntz").alias("cell_start"), "n_rows", F.round("value", 4).alias("value"), F.round("coverage", 6).alias("coverage"), "state")
