"""Registered queries of the data-preparation operators over the tables of TESTDATA.md.

Channel means the text without blanks around it; a date counts where it stands in
``calendar_days``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.operators import badrows, heavykeys, profile, regular, trailing
from skeinworks.session import read_table, stage

_LINE = ("line_id", "file_name", "line_no", "layout")
_FIELDS_OF_LINE = tuple(badrows.Field(*x) for x in (("date", "date", True), ("channel", "text", True), ("deliver_qty", "float"), ("return_qty", "float")))
#: The two layouts of caven20_lines, by their name there.
LAYOUTS = {"csv": badrows.RecordLayout(_FIELDS_OF_LINE), "fwf": badrows.RecordLayout(_FIELDS_OF_LINE, ((0, 10), (10, 84), (84, 124), (124, 164)))}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavykeys.heavy_keys(read_table(spark, d, "caven20"), "channel", 0.02)


def p2_channel_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = heavykeys.key_totals(read_table(spark, d, "caven20"), "channel", ["deliver_qty", "return_qty"])
    return totals.withColumns({c: F.round(c, 1) for c in ("deliver_qty_sum", "return_qty_sum")})


#: A channel: customer / product line / pack / region.
CHANNEL = r"[0-9]{7}/[0-9]{10}/[0-9]{2}-[0-9]{2}/[0-9]{2}"


#: When a load of this feed is unlike the others.
STEPS = profile.Steps(share=0.08, shape=0.15, deviations=6.0, floor=0.04, share_chance=(6.0, 4.0), level_chance=(8.0, 40.0), end_chance=(8.0, 15.0))


def load_months(feed: DataFrame) -> DataFrame:
    """The month a load is about: the one before it first came."""
    first = F.trunc(F.add_months(F.trunc(F.col("at").cast("date"), "month"), -1), "month")
    months = feed.groupBy(F.col("load_id").cast("long").alias("part")).agg(F.min("loaded_at").alias("at"))
    return months.select("part", F.unix_date(first).alias("first_day"), F.unix_date(F.add_months(first, 1)).alias("next_day"))


def calendar_span(calendar: DataFrame) -> tuple[int, int] | None:
    """First and last day of the calendar, as days since 1970-01-01."""
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.unix_date("a"), F.unix_date("b")).first()
    return None if span[0] is None else (span[0], span[1])


def p3_unlike(spark: SparkSession, d: str) -> DataFrame:
    feed = read_table(spark, d, "caven20")
    return profile.unlike_loads(feed, "load_id", ["deliver_qty", "return_qty"], ["date"], stage(load_months(feed)), STEPS, days=calendar_span(read_table(spark, d, "calendar_days")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_unlike(spark, d).select(F.col("load_id").cast("int").alias("load_id"), "column_name")


#: Every column of caven20 by kind: numbers, dates, texts with their pattern.
_ALL_COLUMNS = (["row_id", "load_id", "deliver_qty", "return_qty"], ["date", "loaded_at"], {"channel": CHANNEL})


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile of every column and load."""
    return profile.column_profile(read_table(spark, d, "caven20"), "load_id", *_ALL_COLUMNS)


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """The same, with rounded shares, and distinct values where they are counted exactly."""
    done = p3_distinct(spark, d)
    exact = F.when(F.col("n_distinct") < profile.DISTINCT, F.col("n_distinct"))
    return done.select("column", "load_id", "n_rows", *[F.round(c, 6).alias(c) for c in ("null_share", "nan_share", "negative_share", "zero_share")], "lowest", "highest", exact.alias("n_distinct"), "n_violations")


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    return trailing.trailing_totals(read_table(spark, d, "caven20"), "channel", "date", ["deliver_qty", "return_qty"], (7, 30), calendar=read_table(spark, d, "calendar_days"))


def p4_trailing_rounded(spark: SparkSession, d: str) -> DataFrame:
    done = p4_trailing(spark, d)
    return done.select("channel", "date", *[F.round(c, 0).alias(c) for c in done.columns if c not in ("channel", "date")])


def p5_regular(spark: SparkSession, d: str) -> DataFrame:
    return regular.regular_series(read_table(spark, d, "caven20"), "channel", "date", "deliver_qty", calendar=read_table(spark, d, "calendar_days"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_regular(spark, d).where("state <> 'observed'").select("channel", F.date_format("cell_start", "yyyy-MM-dd").alias("missing_day"))


def p5_weekly(spark: SparkSession, d: str) -> DataFrame:
    done = regular.regular_series(read_table(spark, d, "caven20"), "channel", "date", "deliver_qty", cell_days=7, hold=14, calendar=read_table(spark, d, "calendar_days"))
    return done.select("channel", "cell_start", "n_rows", F.round("coverage", 6).alias("coverage"), "state")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parse_records(badrows.without_headers(read_table(spark, d, "caven20_lines"), "line_no", "layout"), "raw_line", "layout", LAYOUTS, _LINE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected_records(_records(spark, d), ("line_id",)).select("line_id")


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    return badrows.valid_records(_records(spark, d)).select("line_id", "date", "channel", "deliver_qty", "return_qty")


def p6_rejects(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected_records(_records(spark, d), _LINE)


QUERIES = {f.__name__: f for f in (p2_found, p2_channel_totals, p3_found, p3_unlike, p3_profile, p3_distinct, p4_trailing, p4_trailing_rounded, p5_found, p5_regular, p5_weekly, p6_found, p6_valid, p6_rejects)}

_READINGS = """k AS (SELECT trim(channel, ' ') AS channel, date, CASE WHEN NOT isnan(deliver_qty) THEN CAST(deliver_qty AS DOUBLE) END AS deliver_qty,
    CASE WHEN NOT isnan(return_qty) THEN CAST(return_qty AS DOUBLE) END AS return_qty
    FROM caven20 WHERE channel IS NOT NULL AND date IN (SELECT date FROM calendar_days))"""
_SPAN = """span AS (SELECT channel, min(date) AS a, max(date) AS z FROM k GROUP BY channel),
    grid AS (SELECT channel, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
    daily AS (SELECT channel, date, count(*) AS n, avg(deliver_qty) AS v, coalesce(sum(deliver_qty), 0) AS dq, coalesce(sum(return_qty), 0) AS rq FROM k GROUP BY ALL)"""
_STATES = f"""WITH {_READINGS}, {_SPAN},
    cut AS (SELECT channel, date AS a, v, n, coalesce(lead(date) OVER (PARTITION BY channel ORDER BY date), date + 1) AS z FROM daily),
    held AS (SELECT *, CASE WHEN v IS NULL THEN a ELSE least(z, CAST(a + CAST(? AS INTEGER) AS DATE)) END AS b FROM cut)"""
_FIELDS = r"""fields AS (SELECT line_id, layout, raw_line,
      CASE WHEN layout = 'csv' THEN regexp_full_match(raw_line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*)){3}') ELSE length(raw_line) = 164 END AS shaped,
      regexp_extract(raw_line, '^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', ['a', 'b', 'c', 'd']) AS f
      FROM caven20_lines WHERE NOT (line_no = 1 AND layout = 'csv')),
    parts AS (SELECT line_id, layout, raw_line, shaped,
      CASE WHEN layout = 'csv' THEN [list_transform([f.a, f.b, f.c, f.d], lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' '))]
      ELSE [[trim(raw_line[1:10], ' '), trim(raw_line[11:84], ' '), trim(raw_line[85:124], ' '), trim(raw_line[125:164], ' ')]] END[1] AS p FROM fields),
    judged AS (SELECT line_id, layout, raw_line, shaped, p, coalesce(shaped AND regexp_full_match(p[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(p[1] AS DATE) IS NOT NULL AND p[2] <> ''
      AND regexp_full_match(p[3], '([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)?') AND regexp_full_match(p[4], '([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)?'), false) AS ok FROM parts)"""
_CELL = '("([^"]|"")*"|[^",]*)'
_QTY = r"([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)?"
_REASON = f"""CASE WHEN raw_line IS NULL THEN 'no record' WHEN layout = 'fwf' AND length(raw_line) <> 164 THEN 'length is not 164'
      WHEN layout = 'csv' AND NOT regexp_full_match(raw_line, '{_CELL}(,{_CELL})*') THEN CASE
        WHEN regexp_full_match(raw_line, '({_CELL},)*"([^"]|"")*') THEN 'unclosed quote'
        WHEN regexp_matches(raw_line, '^({_CELL},)*"([^"]|"")*"[^",]') THEN 'text after closing quote' ELSE 'stray quote' END
      WHEN layout = 'csv' AND NOT shaped THEN CASE WHEN len(string_split(regexp_replace(raw_line, '"([^"]|"")*"', '', 'g'), ',')) < 4 THEN 'too few fields' ELSE 'too many fields' END
      WHEN NOT (regexp_full_match(p[1], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(p[1] AS DATE) IS NOT NULL) THEN 'invalid date'
      WHEN p[2] = '' THEN 'empty channel' WHEN NOT regexp_full_match(p[3], '{_QTY}') THEN 'invalid deliver_qty' ELSE 'invalid return_qty' END"""
#: Distinct values as far as the profile counts them exactly.
_EXACT = f"CASE WHEN count(DISTINCT {{c}}) < {profile.DISTINCT} THEN count(DISTINCT {{c}}) END AS n_distinct"

ORACLE = {
    "p2_found": "SELECT trim(channel, ' ') AS channel FROM caven20 WHERE channel IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM caven20)",
    "p2_channel_totals": """SELECT trim(channel, ' ') AS channel, count(*) AS n_rows,
        count(CASE WHEN NOT isnan(deliver_qty) THEN 1 END) AS deliver_qty_n, round(sum(CASE WHEN NOT isnan(deliver_qty) THEN CAST(deliver_qty AS DOUBLE) END), 1) AS deliver_qty_sum,
        count(CASE WHEN NOT isnan(return_qty) THEN 1 END) AS return_qty_n, round(sum(CASE WHEN NOT isnan(return_qty) THEN CAST(return_qty AS DOUBLE) END), 1) AS return_qty_sum
        FROM caven20 GROUP BY 1""",
    "p3_profile": "WITH k AS (SELECT *, CAST(load_id AS BIGINT) AS l FROM caven20) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, l AS load_id, count(*) AS n_rows, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_share, round(count(*) FILTER (isnan({v})) / count(*), 6) AS nan_share,
        round(count(*) FILTER ({v} < 0 AND NOT isnan({v})) / count(*), 6) AS negative_share, round(count(*) FILTER ({v} = 0) / count(*), 6) AS zero_share,
        min(CASE WHEN NOT isnan({v}) THEN {v} END) AS lowest, max(CASE WHEN NOT isnan({v}) THEN {v} END) AS highest, {_EXACT.format(c=c)},
        CAST({bad} AS BIGINT) AS n_violations FROM k GROUP BY l"""
        for c, v, bad in (
            *((n, f"CAST({n} AS DOUBLE)", "0") for n in ("row_id", "load_id", "deliver_qty", "return_qty")),
            ("channel", "CAST(NULL AS DOUBLE)", f"count(*) FILTER (channel IS NOT NULL AND NOT regexp_full_match(channel, '{CHANNEL}'))"),
        )
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT '{c}', l, count(*), round(count(*) FILTER ({c} IS NULL) / count(*), 6), 0, 0, 0, CAST(min(CAST({c} AS DATE) - CAST('1970-01-01' AS DATE)) AS DOUBLE),
        CAST(max(CAST({c} AS DATE) - CAST('1970-01-01' AS DATE)) AS DOUBLE), {_EXACT.format(c=c)}, 0 FROM k GROUP BY l"""
        for c in ("date", "loaded_at")
    ),
    "p4_trailing_rounded": f"WITH {_READINGS}, {_SPAN}, full_grid AS (SELECT channel, date, coalesce(dq, 0) AS dq, coalesce(rq, 0) AS rq FROM grid LEFT JOIN daily USING (channel, date)) SELECT channel, date, "
    + ", ".join(f"round(sum({c}) OVER w{p} / {by}, 0) + 0 AS {n}_{what}_{p}d" for c, n in (("dq", "deliver_qty"), ("rq", "return_qty")) for p in (7, 30) for what, by in (("sum", 1), ("avg", p)))
    + " FROM full_grid WINDOW w7 AS (PARTITION BY channel ORDER BY date ROWS 6 PRECEDING), w30 AS (PARTITION BY channel ORDER BY date ROWS 29 PRECEDING)",
    "p5_found": f"WITH {_READINGS}, {_SPAN} SELECT channel, strftime(date, '%Y-%m-%d') AS missing_day FROM grid ANTI JOIN daily USING (channel, date)",
    "p5_regular": _STATES.replace("?", "7")
    + """ SELECT g.channel, g.date AS cell_start, CASE WHEN g.date = h.a THEN h.n ELSE 0 END AS n_rows, CASE WHEN g.date < h.b THEN h.v END AS value,
        CASE WHEN g.date < h.b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS coverage, CASE WHEN g.date = h.a THEN 'observed' WHEN g.date < h.b THEN 'filled' ELSE 'missing' END AS state
        FROM grid g JOIN held h ON g.channel = h.channel AND g.date >= h.a AND g.date < h.z""",
    "p5_weekly": _STATES.replace("?", "14")
    + """ , days AS (SELECT g.channel, CAST('1970-01-01' AS DATE) + CAST(floor((g.date - CAST('1970-01-01' AS DATE)) / 7) * 7 AS INTEGER) AS cell_start, CASE WHEN g.date = h.a THEN h.n ELSE 0 END AS n,
        CASE WHEN g.date < h.b THEN 1 ELSE 0 END AS held FROM grid g JOIN held h ON g.channel = h.channel AND g.date >= h.a AND g.date < h.z)
        SELECT channel, cell_start, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(held) / count(*), 6) AS coverage, CASE WHEN sum(n) > 0 THEN 'observed' WHEN sum(held) > 0 THEN 'filled' ELSE 'missing' END AS state FROM days GROUP BY ALL""",
    "p6_found": f"WITH {_FIELDS} SELECT line_id FROM judged WHERE NOT ok",
    "p6_rejects": f"""WITH {_FIELDS} SELECT line_id, file_name, line_no, layout, {_REASON} AS reason FROM judged JOIN (SELECT line_id, file_name, line_no FROM caven20_lines) USING (line_id) WHERE NOT ok""",
    "p6_valid": f"WITH {_FIELDS} SELECT line_id, CAST(p[1] AS DATE) AS date, p[2] AS channel, CAST(nullif(p[3], '') AS FLOAT) AS deliver_qty, CAST(nullif(p[4], '') AS FLOAT) AS return_qty FROM judged WHERE ok",
}
