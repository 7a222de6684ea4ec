"""An order of the cells of any rectangle in which neighbours stay near, as rows and as a table function.

The rectangle is cut into strips of ``STRIP`` lines.  A strip is run through column by
column, down one and up the next, and the strips in turn to the right and to the left.
With an even number of columns the last two are run through together, line by line, so
that a strip always ends on the side of the next one.  Every step goes to a cell that
touches the last, and the place of a cell follows from its number alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRIP = 8


def cell_at(at: int, width: int, height: int) -> tuple[int, int]:
    """The cell of a number."""
    strip, rest = divmod(at, width * STRIP)
    lines = min(STRIP, height - strip * STRIP)
    single = width - (1 - width % 2) * 2  # columns that are run through one by one
    if rest < single * lines:
        column, line = divmod(rest, lines)
        line = lines - 1 - line if column % 2 else line
    else:
        line, side = divmod(rest - single * lines, 2)
        column = single + (1 - side if line % 2 else side)
    return (width - 1 - column if strip % 2 else column), strip * STRIP + line


def curve(width: int, height: int) -> Iterator[tuple[int, int]]:
    """Every cell of the rectangle once, each touching the last."""
    return (cell_at(i, width, height) for i in range(width * height))


def curve_rows(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(``pos``, ``x``, ``y``) of every cell, made where it is needed: a rectangle of any size is no larger than its partitions."""
    at = F.col("id")

    def div(a: Column, b) -> Column:
        return F.floor(a / b).cast("long")

    strip = div(at, width * STRIP)
    rest = at - strip * (width * STRIP)
    lines = F.least(F.lit(STRIP), F.lit(height) - strip * STRIP)
    single = width - (1 - width % 2) * 2
    first = rest < lines * single
    down, pair = rest % lines, rest - lines * single
    alone = div(rest, lines)
    line = F.when(first, F.when(alone % 2 == 1, lines - 1 - down).otherwise(down)).otherwise(div(pair, 2))
    side = F.when(div(pair, 2) % 2 == 1, 1 - pair % 2).otherwise(pair % 2)
    column = F.when(first, alone).otherwise(side + single)
    x = F.when(strip % 2 == 1, F.lit(width - 1) - column).otherwise(column)
    return spark.range(width * height).select(at.alias("pos"), x.cast("int").alias("x"), (strip * STRIP + line).cast("int").alias("y"))


def register_curve(spark):
    """Table function ``space_curve(width, height)`` -> (``pos``, ``x``, ``y``)."""

    @F.udtf(returnType="pos bigint, x int, y int")
    class SpaceCurve:
        def eval(self, width: int, height: int):
            for i, (x, y) in enumerate(curve(width, height)):
                yield i, x, y

    spark.udtf.register("space_curve", SpaceCurve)
    return SpaceCurve
