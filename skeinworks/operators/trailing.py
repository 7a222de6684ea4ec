"""Totals and averages over trailing periods, for every entity and calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.session import fits_broadcast, only, quoted

#: Days up to which a calendar is broadcast: more than 2,700 years.
CALENDAR_DAYS = 1_000_000


def calendar_rows(df: DataFrame, entity: str, day: str, calendar: DataFrame | None, calendar_day: str = "date") -> DataFrame:
    """Rows with an entity (trimmed) and a day found in the calendar; ``__e`` and ``__d`` hold them.

    A calendar has a row per day, so it is broadcast as long as it has no more distinct
    days than ``CALENDAR_DAYS``; a longer one is joined by shuffle.
    """
    rows = df.withColumns({"__e": F.trim(quoted(entity).cast("string")), "__d": quoted(day).cast("date")}).where("__e IS NOT NULL AND __d IS NOT NULL")
    if calendar is not None:
        days = calendar.select(quoted(calendar_day).cast("date").alias("__d")).distinct()
        rows = rows.join(F.broadcast(days) if fits_broadcast(days, CALENDAR_DAYS) else days, "__d", "left_semi")
    return rows


def trailing_totals(df: DataFrame, entity: str, day: str, values: Sequence[str], periods: Sequence[int] = (7, 30), *, calendar: DataFrame | None = None, calendar_day: str = "date") -> DataFrame:
    """Totals and daily averages of ``values`` over the last 7, 30, ... days.

    A row for each entity and each day from its first to its last, days without
    rows included.  Columns: entity, day, then for each value and period
    ``<v>_sum_<p>d`` and ``<v>_avg_<p>d``.

    Each daily total is exploded onto every day it influences (itself and the
    following ``max(periods) - 1`` days, up to the entity's last day), the copies
    are summed by entity and day.  The calendar rows for the zeros join in as further
    copies, worth nothing, of the daily total before a gap: a join proper on entity and
    day would shuffle the copies once more.  Daily totals come first, so that an entity
    has at most one row per day and no entity is large; all further steps keep the
    partitioning by entity.

    * The average is the total over the number of days of the period, days without
      rows and days before the entity's first day counting as zero.
    * Null and NaN values add nothing.  Rows without entity or day, and rows of days
      outside the calendar, are left out.  Repeated rows are rows.
    * An empty table gives an empty result; clashing names of other columns are
      harmless because only the named columns are read.
    """
    df = only(df, entity, day, *values)
    periods, values = sorted({int(p) for p in periods}), list(values)
    if not periods or periods[0] < 1:
        raise ValueError("periods must be positive numbers of days")
    rows = calendar_rows(df, entity, day, calendar, calendar_day)
    number = [quoted(v).cast("double") for v in values]
    daily = (
        rows.select("__e", "__d", *[F.when(~F.isnan(c), c).alias(f"v{i}") for i, c in enumerate(number)])
        .groupBy("__e", "__d")
        .agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0.0)).alias(f"v{i}") for i in range(len(values))])
        .repartition("__e")
    )
    longest = periods[-1]
    series = Window.partitionBy("__e")
    last, following = F.max("__d").over(series), F.lead("__d").over(series.orderBy("__d"))
    until = F.greatest(F.least(F.date_add("__d", longest - 1), "__last"), F.coalesce(F.date_sub("__next", 1), "__last"))
    influence = daily.withColumns({"__last": last, "__next": following}).select(
        "__e", F.col("__d").alias("__from"), *[f"v{i}" for i in range(len(values))], F.explode(F.sequence("__d", until)).alias("__d")
    )
    totals = [
        F.sum(F.when(F.datediff("__d", "__from") < p, F.col(f"v{i}")).otherwise(0.0)).alias(f"t{i}_{p}")
        for i in range(len(values))
        for p in periods
    ]
    moved = influence.groupBy("__e", "__d").agg(*totals)
    out = [quoted("__e").alias(entity), quoted("__d").alias(day)]
    for i, v in enumerate(values):
        for p in periods:
            total = F.col(f"t{i}_{p}")
            out += [total.alias(f"{v}_sum_{p}d"), (total / p).alias(f"{v}_avg_{p}d")]
    return moved.select(*out)
