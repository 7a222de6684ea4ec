"""Dates: day sequences, calendar features, other calendars, lenient parsing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.session import quoted

EPOCH_DAY = "1970-01-01"
#: Fields of a date in the order in which they are given.
FIELDS = ("DAY_OF_WEEK", "DAY_OF_MONTH", "ALIGNED_WEEK_OF_MONTH", "MONTH_OF_YEAR", "YEAR")
#: Calendars that differ from ISO in the year only.
YEAR_SHIFT = {"Iso": 0, "ThaiBuddhist": 543, "Minguo": -1911, "Japanese": 0}
#: Calendars that need the JVM's tables.
JVM_CALENDARS = ("Hijrah",)
# The years of the Hijrah calendar's tables.
HIJRAH_YEARS = (1300, 1600)


def day_sequence(first: Column, end: Column) -> Column:
    """Array of the days from ``first`` up to, not including, ``end``; empty if there are none."""
    empty = F.array().cast("array<date>")
    return F.when(first.isNull() | end.isNull(), F.lit(None).cast("array<date>")).when(end > first, F.sequence(first, F.date_sub(end, 1))).otherwise(empty)


def date_fields(day: Column, calendar: str = "Iso") -> dict[str, Column]:
    """Features of a date by field; the Japanese calendar has no week of the month."""
    shift = YEAR_SHIFT[calendar]
    out = {
        "DAY_OF_WEEK": F.weekday(day) + 1,
        "DAY_OF_MONTH": F.dayofmonth(day),
        "ALIGNED_WEEK_OF_MONTH": (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int"),
        "MONTH_OF_YEAR": F.month(day),
        "YEAR": F.year(day) + shift,
    }
    if calendar == "Japanese":
        del out["ALIGNED_WEEK_OF_MONTH"]
    return out


def calendar_features(df: DataFrame, day: str, calendar: str = "Iso", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row with the int columns ``<calendar>:<field>``, and the columns ``keep``.

    Days a calendar does not know (Hijrah has the years 1300 to 1600) give null.
    """
    d = quoted(day).cast("date")
    if calendar in JVM_CALENDARS:
        starts = hijrah_months(df.sparkSession)
        first = np.array([x[2] for x in starts], np.int64)
        year, month = (np.array([x[i] for x in starts]) for i in (0, 1))

        @F.pandas_udf(", ".join(f"`{f}` int" for f in FIELDS))
        def fields(days: pd.Series) -> pd.DataFrame:
            n = days.to_numpy(np.float64, na_value=np.nan)
            known = (n >= first[0]) & (n < first[-1])
            n = np.where(known, n, first[0]).astype(np.int64)
            at = np.searchsorted(first, n, "right") - 1
            of_month = n - first[at] + 1
            found = ((n + 3) % 7 + 1, of_month, (of_month - 1) // 7 + 1, month[at], year[at])
            return pd.DataFrame({f: pd.Series(x, dtype="Int32").where(known) for f, x in zip(FIELDS, found)})

        rows = df.select(*[quoted(k) for k in keep], fields(F.unix_date(d)).alias("__f"))
        return rows.select(*[quoted(k) for k in keep], *[F.col(f"__f.`{f}`").alias(f"{calendar}:{f}") for f in FIELDS])
    return df.select(*[quoted(k) for k in keep], *[c.cast("int").alias(f"{calendar}:{f}") for f, c in date_fields(d, calendar).items()])


_months: list[tuple[int, int, int]] = []


def hijrah_months(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(year, month, first day since 1970-01-01) of every Hijrah month the JVM knows, and the day after the last; a few thousand, read once."""
    if not _months:
        of = spark._jvm.java.time.chrono.HijrahChronology.INSTANCE
        low, high = HIJRAH_YEARS
        last = of.date(high, 12, 1)
        end = (high + 1, 1, int(last.toEpochDay()) + int(last.lengthOfMonth()))
        months = [(y, m, int(of.date(y, m, 1).toEpochDay())) for y in range(low, high + 1) for m in range(1, 13)]
        _months.extend([*months, end])
    return _months


def lenient_date(text: Column) -> Column:
    """ISO date; what does not parse is 1970-01-01."""
    return F.coalesce(F.try_to_date(F.trim(text)), F.lit(EPOCH_DAY).cast("date"))


def lenient_instant(text: Column) -> Column:
    """ISO instant; what does not parse is the epoch."""
    return F.coalesce(F.try_to_timestamp(F.trim(text)), F.timestamp_millis(F.lit(0)))


def epoch_millis(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers or texts of milliseconds become timestamps (else the epoch) and move to the front."""
    front = [F.timestamp_millis(F.coalesce(quoted(c).cast("string").try_cast("bigint"), F.lit(0))).alias(c) for c in columns]
    return df.select(*front, *[quoted(c) for c in df.columns if c not in columns])
