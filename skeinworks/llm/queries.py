"""Registered queries of this sub-package, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.llm import encoding, leakage, mixture, radix
from skeinworks.session import read_table, stage


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    done = radix.radix_percentiles(read_table(spark, d, "caven20"), "channel", "load_id", ["deliver_qty", "return_qty"])
    return done.withColumn("load_id", F.col("load_id").cast("long"))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable summaries of early and late loads, combined: values and extremes of each channel, load and measure."""
    feed, names = read_table(spark, d, "caven20"), ["deliver_qty", "return_qty"]
    halves = [radix.digit_histogram(feed.where(w), "channel", "load_id", names) for w in ("load_id < 20", "load_id >= 20 OR load_id IS NULL")]
    return radix.merge_histograms(*halves).groupBy("k", F.col("g").cast("long").alias("g"), "m").agg(F.sum("n").alias("n"), F.min("lo").cast("float").alias("lowest"), F.max("hi").cast("float").alias("highest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "item_text")


def p7_planted(spark: SparkSession, d: str) -> DataFrame:
    """Six tenths of every item planted among all documents, in capitals, an advert between their cues: who is found in what?"""
    items = read_table(spark, d, "eval_items")
    w = F.split(F.upper("item_text"), r"\s+")
    n = F.ceil(F.size(w) * 0.6).cast("int")
    cue = lambda i, text: F.concat(F.lit(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\n"), text, F.lit("\n\n"))
    line = lambda a, b: F.array_join(F.slice(w, a, b), " ")
    text = F.concat(cue(1, F.lit("Something else comes before")), cue(2, line(F.lit(1), F.lit(8))), cue(3, F.lit("Get this and more at our place")), cue(4, line(F.lit(9), n - 8)), cue(5, F.lit("and after it")))
    documents = read_table(spark, d, "documents").select("doc_id", "text").unionByName(items.select((-F.col("item_id")).alias("doc_id"), text.alias("text")))
    return leakage.leaks(documents, "doc_id", "text", items, "item_id", "item_text").where("doc_id < 0")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    counted = stage(mixture.token_counts(read_table(spark, d, "documents"), "doc_id", "text", "source"))
    return mixture.mix(counted, read_table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.reached(p8_mixture(spark, d), read_table(spark, d, "mix_targets"))


def p8_held(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: is its share met as closely as whole documents allow, and its cap kept?  Recomputed from the chosen documents."""
    used = p8_mixture(spark, d).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("n_tokens").alias("longest"), F.max("copies").alias("most"))
    over_all = Window.partitionBy()  # one row per target source
    rows = read_table(spark, d, "mix_targets").join(used, "source", "left").withColumns({"whole": F.sum("t").over(over_all), "slack": 2 * F.max("longest").over(over_all), "k": F.count(F.lit(1)).over(over_all)})
    gap = F.abs(F.coalesce("t", F.lit(0)) - F.col("target_share") * F.col("whole"))
    return rows.select("source", (gap <= F.col("slack") * (1 + F.col("target_share") * F.col("k"))).alias("share_met"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.affected(read_table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(read_table(spark, d, "documents"), "doc_id", "text")


#: Lines, and the chains by which they are written and read wrongly, that ``p9_planted`` adds to the documents.
PLANTED = (
    ("Cette forêt mystérieuse était éloignée", ("utf-8", "cp1252")),
    ("Der kühne Müßiggänger übt schläfrig", ("cp1252", "cp850")),
    ("Zażółć gęślą jaźń, źrebię", ("cp1250", "cp1252")),
    ("Съешь ещё этих мягких французских булок", ("cp1251", "cp1252")),
    ("Широкая электрификация южных губерний", ("koi8-r", "cp1251")),
    ("El pingüino Wenceslao hizo kilómetros", ("utf-8", "cp1252", "utf-8", "cp1252")),
    ("Então vovô Kowalsky não vê o ímã cair", ("mac_roman", "cp1252")),
)


def p9_planted(spark: SparkSession, d: str) -> DataFrame:
    """Known garbled lines among all documents, restored; each stands intact three times too."""
    rows = []
    for i, (line, chain) in enumerate(PLANTED):
        wrong = line
        for a, b in zip(chain[::2], chain[1::2]):
            wrong = encoding.read_as(wrong.encode(a), b)
        rows += [(-1 - i, wrong), *((-1000 - 10 * i - k, f"{line} {k}") for k in range(3))]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    done = encoding.restored(read_table(spark, d, "documents").select("doc_id", "text").unionByName(planted), "doc_id", "text")
    return done.where("doc_id < 0").select("doc_id", "restored_text", "complete")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_summary, p7_found, p7_planted, p8_mixture, p8_shares, p8_held, p9_found, p9_restored, p9_planted)}

_VALUES = """v AS (SELECT trim(channel, ' ') AS channel, CAST(load_id AS BIGINT) AS load_id, 'deliver_qty' AS measure, deliver_qty + 0 AS x FROM caven20 WHERE NOT isnan(deliver_qty) AND channel IS NOT NULL
    UNION ALL SELECT trim(channel, ' '), CAST(load_id AS BIGINT), 'return_qty', return_qty + 0 FROM caven20 WHERE NOT isnan(return_qty) AND channel IS NOT NULL),
    r AS (SELECT channel, load_id, false AS all_parts, measure, x FROM v UNION ALL SELECT channel, NULL, true, measure, x FROM v)"""
ORACLE: dict[str, str] = {
    "p7_planted": "SELECT -item_id AS doc_id, item_id FROM eval_items",
    "p8_held": "SELECT source, true AS share_met, true AS cap_kept FROM mix_targets",
    "p9_planted": "SELECT * FROM (VALUES " + ", ".join(f"(CAST({-1 - i} AS BIGINT), '{line}', true)" for i, (line, _) in enumerate(PLANTED)) + ") t(doc_id, restored_text, complete)",
    "p1_percentiles": f"""WITH {_VALUES}, l AS (SELECT channel, load_id, all_parts, measure, count(*) AS n, list_sort(list(x)) AS xs FROM r GROUP BY ALL)
        SELECT channel, load_id, all_parts, measure, n, """
    + ", ".join(f"CAST(xs[greatest(1, (n * {q} + 999) // 1000)] AS DOUBLE) AS p{q}" for q in (50, 250, 500, 750, 950, 990))
    + ", CAST(0 AS DOUBLE) AS error_bound FROM l",
    "p1_summary": f"WITH {_VALUES} SELECT channel AS k, load_id AS g, CASE measure WHEN 'deliver_qty' THEN 0 ELSE 1 END AS m, count(*) AS n, min(x) AS lowest, max(x) AS highest FROM v GROUP BY ALL",
}
