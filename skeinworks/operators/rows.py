"""Row order: the ordinal column ``__row`` and the operators that go by it.

A DataFrame has no order.  Where order carries meaning, a column ``__row`` (0, 1, ...
without gaps) says it; operators here read or make it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.session import quoted, stage

ROW = "__row"


def with_row(df: DataFrame, *keys: str) -> DataFrame:
    """Number the rows 0, 1, ... in the order of ``keys`` (nulls first; they should be unique).

    Rows are sorted in ranges and written once with their place in their range; the
    sizes of the ranges before give the rest.  No range is larger than any other
    sort's, and the driver only sees one number per range.
    """
    placed = stage(df.orderBy(*[quoted(k) for k in keys]).withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r[0]: r[1] for r in placed.groupBy("__range").count().collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    if not starts:
        return placed.withColumn(ROW, F.col("__place")).drop("__range", "__place")
    before = df.sparkSession.createDataFrame(starts, "__range int, __start bigint")  # a row per range
    return placed.join(F.broadcast(before), "__range").withColumn(ROW, F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")


def numbered_by(df: DataFrame, key: str) -> DataFrame:
    """Take an integer key that already counts 0, 1, ... as ``__row``."""
    return df.withColumn(ROW, quoted(key).cast("long"))


def row_at(df: DataFrame, n: int) -> DataFrame:
    """The n-th row."""
    return df.where(F.col(ROW) == n)


def slice_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows from ``start`` up to, not including, ``end``."""
    return df.where((F.col(ROW) >= start) & (F.col(ROW) < end))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows."""
    return slice_rows(df, 0, n)


def gather_rows(df: DataFrame, picks: DataFrame, at: str = ROW) -> DataFrame:
    """Rows by a table of row numbers, in its order (column ``pos``); repeats are repeated.

    ``picks`` has ``pos`` and the row number; numbers that no row has give nothing.
    """
    return picks.select("pos", quoted(at).alias(ROW)).join(df, ROW).drop(ROW).withColumnRenamed("pos", ROW)


def pick_rows(df: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """``gather_rows`` with a list."""
    picks = df.sparkSession.createDataFrame(list(enumerate(numbers)), f"pos bigint, {ROW} bigint")
    return gather_rows(df, picks)


def reverse_rows(df: DataFrame) -> DataFrame:
    """Renumber from the end."""
    last = df.agg(F.max(ROW)).first()[0]
    return df.withColumn(ROW, F.lit(last).cast("long") - F.col(ROW))


def first_last(df: DataFrame, column: str) -> DataFrame:
    """One row: the column's first and last value."""
    return df.agg(F.min_by(quoted(column), ROW).alias("first"), F.max_by(quoted(column), ROW).alias("last"))


def positional_join(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns beside each other, row by row; as many rows as the left table has.

    Names that occur again get a number behind them.
    """
    out = left
    for o in others:
        taken = {c.lower() for c in out.columns}
        names = []
        for c in o.columns:
            n, name = 1, c
            while c != ROW and name.lower() in taken:
                name, n = f"{c}_{n}", n + 1
            taken.add(name.lower())
            names.append(quoted(c).alias(name))
        out = out.join(o.select(*names), ROW, "left")
    return out


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """As ``positional_join``, but as many rows as the shorter table has."""
    names = [quoted(c).alias(c if c == ROW or c.lower() not in {x.lower() for x in left.columns} else f"{c}_1") for c in right.columns]
    return left.join(right.select(*names), ROW)


def concat_rows(*tables: DataFrame) -> DataFrame:
    """UNION ALL by position, renumbered: the rows of the first table, then of the next."""
    out, offset = None, 0
    for t in tables:
        part = t.withColumn(ROW, F.col(ROW) + F.lit(offset))
        out = part if out is None else out.union(part.select(*t.columns[: t.columns.index(ROW)], ROW, *t.columns[t.columns.index(ROW) + 1 :]))
        size = t.agg(F.max(ROW)).first()[0]
        offset += 0 if size is None else size + 1
    return out


def split_rows(df: DataFrame, parts: int) -> DataFrame:
    """Column ``part``: ``parts`` equal ranges of rows, what is over in the last."""
    each = max(1, df.count() // parts)
    return df.withColumn("part", F.least(F.floor(F.col(ROW) / each), F.lit(parts - 1)).cast("int"))


def pair_chunks(df: DataFrame, column: str) -> DataFrame:
    """Neighbours as pairs that do not overlap, (0, 1), (2, 3), ...; an odd last row is dropped."""
    pair = df.groupBy(F.floor(F.col(ROW) / 2).alias("pair")).agg(F.min_by(quoted(column), ROW).alias("first"), F.max_by(quoted(column), ROW).alias("second"), F.count(F.lit(1)).alias("__n"))
    return pair.where("__n = 2").drop("__n")


def cyclic_repeat(df: DataFrame, limit: int) -> DataFrame:
    """Rows repeated in their order until there are ``limit``."""
    n = df.count()
    if not n:
        return df
    return df.sparkSession.range(limit).select(F.col("id").alias("pos"), (F.col("id") % n).alias(ROW)).join(df, ROW).drop(ROW).withColumnRenamed("pos", ROW)


def horizon_rows(df: DataFrame, view: int) -> DataFrame:
    """``view`` rows, dense at the head and ever sparser: row i is ``max(i, int(n - 2 - n * sin((view - i) / view * pi / 2)))``."""
    n = df.count()
    i = F.col("id")
    far = F.lit(n - 2) - F.sin((F.lit(view) - i) / view * F.lit(math.pi / 2)) * n
    picks = df.sparkSession.range(view).select(i.alias("pos"), F.greatest(i, far.cast("long")).alias(ROW))
    return picks.join(df, ROW).withColumnRenamed(ROW, "source_row").withColumnRenamed("pos", ROW)


def ordered(df: DataFrame, *keys: str, ascending: bool = True) -> DataFrame:
    """Sort by typed keys, nulls first; ties keep their row order."""
    return with_row(df.withColumnRenamed(ROW, "__was"), *keys, "__was").drop("__was") if ascending else _descending(df, keys)


def _descending(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    flip = reverse_rows(with_row(df.withColumnRenamed(ROW, "__was").withColumn("__back", -F.col("__was")), *keys, "__back"))
    return flip.drop("__was", "__back")


def as_text(*keys: str) -> list:
    """Keys as the text that ``ordered_text`` sorts by: 10 before 9, null as "null"."""
    return [F.coalesce(quoted(k).cast("string"), F.lit("null")) for k in keys]


def ordered_text(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by the keys' text, joined by NUL; ties keep their row order."""
    joined = df.withColumnRenamed(ROW, "__was").withColumn("__text", F.concat_ws("\0", *as_text(*keys)))
    return with_row(joined, "__text", "__was").drop("__text", "__was")


def last_rows(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows, of each group if ``by`` is given: what a ring buffer of size n keeps.

    Without ``by`` this is a top-n, not a window over the whole table.
    """
    if not by:
        return df.orderBy(F.desc(ROW)).limit(n)
    back = Window.partitionBy(*[quoted(b) for b in by]).orderBy(F.desc(ROW))
    return df.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n).drop("__back")


def trailing_values(df: DataFrame, column: str, n: int, *by: str, name: str = "trailing") -> DataFrame:
    """For each row the values of the last n rows of its group, oldest first, nulls kept."""
    frame = Window.partitionBy(*[quoted(b) for b in by]).orderBy(ROW).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.transform(F.collect_list(F.struct(quoted(column).alias("v"))).over(frame), lambda x: x["v"]))


def sample_rows(df: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """``n`` rows chosen at random, the same ones for the same seed; all if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(ROW))).limit(n)


def as_lines(df: DataFrame) -> list[str]:
    """What ``show`` prints: how many rows there are and their columns, then the cells of each row."""
    names = [c for c in df.columns if c != ROW]
    ordered_ = df.orderBy(ROW) if ROW in df.columns else df
    return [f"rows: {df.count()} {names}", *(str([r[c] for c in names]) for r in ordered_.collect())]


def show(df: DataFrame, first: int = 0, end: int | None = None) -> None:
    """Print the rows ``first`` up to, not including, ``end``; meant for few."""
    print(*as_lines(df.where(F.col(ROW) >= first) if end is None else slice_rows(df, first, end)), sep="\n")


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One step that runs all, the first given first."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
