"""Irregular readings onto a regular grid, through validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.operators.trailing import calendar_rows
from skeinworks.session import only, quoted


def step_intervals(daily: DataFrame, hold: int | None) -> DataFrame:
    """Turn readings (``__e``, ``__d``, ``value``, ``n_rows``) into a step function.

    Adds ``until``, the day on which the next reading of the entity (or the end of
    its series) takes over, and ``valid_until``, where the reading itself stops being
    valid: the same, but at most ``hold`` days after it was taken.  A reading without
    a value is valid nowhere.
    """
    order = Window.partitionBy("__e").orderBy("__d")
    until = F.coalesce(F.lead("__d").over(order), F.date_add("__d", 1))
    held = until if hold is None else F.least(until, F.date_add("__d", hold))
    return daily.withColumn("until", until).withColumn("valid_until", F.when(F.col("value").isNotNull(), held).otherwise(F.col("__d")))


def regular_series(df: DataFrame, entity: str, day: str, value: str, *, cell_days: int = 1, hold: int | None = 7, calendar: DataFrame | None = None, calendar_day: str = "date") -> DataFrame:
    """A gap-free series of grid cells per entity, from its first to its last reading.

    The readings of a day are averaged, each becomes the interval in which its value
    holds (until the next reading, at most ``hold`` days; None: without limit), the
    intervals are cut at the borders of the cells (``cell_days`` days, counted from
    1970-01-01), and each cell gets

    * ``n_rows``: rows of the entity dated in the cell, whatever their values,
    * ``value``: the time-weighted average of the intervals in it, null if none,
    * ``coverage``: the fraction of the cell's days (those within the series) that a
      valid interval covers,
    * ``state``: ``observed`` (it has rows), ``filled`` (no rows, a value carried
      forward) or ``missing`` (neither).

    Columns: entity, ``cell_start`` and these.  Rows without entity or day, or dated
    outside the calendar, are left out; a row whose value is null or NaN counts in
    ``n_rows`` but ends the previous interval with nothing.  Rows of one day that are
    repeated or tied are averaged.  An empty table gives an empty result; other
    columns are not read.  After the daily step an entity has at most one row per
    day, so a hot entity is no larger than the calendar.
    """
    if cell_days < 1 or (hold is not None and hold < 1):
        raise ValueError("cell_days and hold must be positive")
    df = only(df, entity, day, value)
    number = quoted(value).cast("double")
    daily = (
        calendar_rows(df, entity, day, calendar, calendar_day)
        .select("__e", "__d", F.when(~F.isnan(number), number).alias("v"))
        .groupBy("__e", "__d")
        .agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n_rows"))
        .repartition("__e")
    )
    cut = step_intervals(daily, hold)
    start, until, valid = (F.unix_date(c) for c in ("__d", "until", "valid_until"))
    cells = cut.select("__e", "value", "n_rows", start.alias("a"), until.alias("z"), valid.alias("b")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("a") / cell_days), F.floor((F.col("z") - 1) / cell_days)))
    )
    low, high = F.col("cell") * cell_days, (F.col("cell") + 1) * cell_days
    inside = lambda end: F.greatest(F.lit(0), F.least(F.col(end), high) - F.greatest(F.col("a"), low))
    parts = cells.select(
        "__e", "cell", "value", inside("b").alias("held"), inside("z").alias("lasts"), F.when((F.col("a") >= low) & (F.col("a") < high), F.col("n_rows")).otherwise(0).alias("here")
    )
    if cell_days > 1:  # several intervals may share a cell
        parts = parts.groupBy("__e", "cell").agg(
            F.sum(F.when(F.col("held") > 0, F.col("value") * F.col("held"))).alias("mass"), F.sum("held").alias("held"), F.sum("lasts").alias("lasts"), F.sum("here").alias("here")
        )
        parts = parts.withColumn("value", F.try_divide("mass", F.col("held")))
    else:
        parts = parts.withColumn("value", F.when(F.col("held") > 0, F.col("value")))
    return parts.select(
        F.col("__e").alias(entity),
        F.date_from_unix_date((F.col("cell") * cell_days).cast("int")).alias("cell_start"),
        F.col("here").alias("n_rows"),
        "value",
        (F.col("held") / F.col("lasts")).alias("coverage"),
        F.when(F.col("here") > 0, "observed").when(F.col("held") > 0, "filled").otherwise("missing").alias("state"),
    )


def regular_series_in_time(df: DataFrame, entity: str, at: str, value: str, *, cell_seconds: int, hold_seconds: int | None = None) -> DataFrame:
    """``regular_series`` of readings with a time of day, in cells of any number of seconds.

    A reading holds from its instant until the next one of its entity, at most
    ``hold_seconds``; the last one until its cell ends.  Cells are counted from
    1970-01-01T00:00Z.  Readings of one instant are averaged.  Columns and the rule for
    nulls, NaN and empty tables are those of ``regular_series``; ``cell_start`` is a
    timestamp.

    An entity may hold any part of all rows: what follows a reading is looked for within
    its day, and only the first readings of the days are put in order over an entity.
    """
    if cell_seconds < 1 or (hold_seconds is not None and hold_seconds < 1):
        raise ValueError("cell_seconds and hold_seconds must be positive")
    df = only(df, entity, at, value)
    size, day = cell_seconds * 1_000_000, 86_400_000_000
    div = lambda c, by: F.expr(f"({c} - pmod({c}, {by})) div {by}")
    number = quoted(value).cast("double")
    readings = (
        df.select(F.trim(quoted(entity).cast("string")).alias("e"), F.unix_micros(quoted(at).cast("timestamp")).alias("t"), F.when(~F.isnan(number), number).alias("v"))
        .where("e IS NOT NULL AND t IS NOT NULL")
        .groupBy("e", "t")
        .agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
        .withColumn("d", div("t", day))
    )
    days = readings.groupBy("e", "d").agg(F.min("t").alias("t"))
    following = days.select("e", "d", F.lead("t").over(Window.partitionBy("e").orderBy("d")).alias("after"))
    within = F.lead("t").over(Window.partitionBy("e", "d").orderBy("t"))
    cut = readings.withColumn("within", within).join(following, ["e", "d"]).withColumn("z", F.coalesce("within", "after", (div("t", size) + 1) * size))
    held = F.col("z") if hold_seconds is None else F.least(F.col("z"), F.col("t") + hold_seconds * 1_000_000)
    cells = cut.withColumn("b", F.when(F.col("v").isNotNull(), held).otherwise(F.col("t"))).withColumn("last", F.col("z") - 1)
    cells = cells.withColumn("cell", F.explode(F.sequence(div("t", size), div("last", size))))
    low, high = F.greatest("t", F.col("cell") * size), (F.col("cell") + 1) * size
    parts = cells.select(
        "e", "cell", "v", F.greatest(F.lit(0), F.least("b", high) - low).alias("held"), (F.least("z", high) - low).alias("lasts"), F.when(F.col("t") >= F.col("cell") * size, F.col("n")).otherwise(0).alias("here")
    )
    summed = parts.groupBy("e", "cell").agg(F.sum(F.when(F.col("held") > 0, F.col("v") * F.col("held"))).alias("mass"), F.sum("held").alias("held"), F.sum("lasts").alias("lasts"), F.sum("here").alias("here"))
    return summed.select(
        F.col("e").alias(entity),
        F.timestamp_micros(F.col("cell") * size).alias("cell_start"),
        F.col("here").alias("n_rows"),
        F.try_divide("mass", F.col("held")).alias("value"),
        (F.col("held") / F.col("lasts")).alias("coverage"),
        F.when(F.col("here") > 0, "observed").when(F.col("held") > 0, "filled").otherwise("missing").alias("state"),
    )
