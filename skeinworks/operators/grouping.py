"""Grouping: nested groups, folds, row indexes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.operators.rows import ROW, with_row
from skeinworks.session import quoted


def _part(i: int) -> Column:
    return F.transform("__items", lambda x: x[f"v{i}"])


def group_nested(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; the other columns become arrays in row order, nulls kept.

    Columns keep their order.  Groups are numbered by first appearance in ``__row``
    (the smallest row number of the group, so with gaps).  Null keys are equal.  A
    group's arrays must fit into memory; use ``group_reduce`` where a fold will do.
    """
    others = [c for c in df.columns if c not in keys and c != ROW]
    item = F.struct(quoted(ROW).alias("r"), *[quoted(c).alias(f"v{i}") for i, c in enumerate(others)])
    grouped = df.groupBy(*[quoted(k) for k in keys]).agg(F.min(ROW).alias(ROW), F.array_sort(F.collect_list(item)).alias("__items"))
    nested = {c: _part(i).alias(c) for i, c in enumerate(others)}
    return grouped.select(*[quoted(c) if c in keys or c == ROW else nested[c] for c in df.columns])


def group_like(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``group_nested`` by the columns that another table has."""
    return group_nested(df, *[c for c in keys.columns if c != ROW])


#: Reducers Spark has; a group in which all is null gives what the name says.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "avg": F.avg,
}


def group_reduce(df: DataFrame, keys: Sequence[str], reducer: str | Callable[[Column, Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Fold the other columns per key.

    A named reducer aggregates on the map side first.  A function ``(so far, value)``
    folds the values in row order, beginning with null, and needs a group in memory;
    where partial results can be merged, ``group_fold`` does not.
    """
    columns = [c for c in df.columns if c not in keys and c != ROW] if columns is None else list(columns)
    if isinstance(reducer, str):
        return df.groupBy(*[quoted(k) for k in keys]).agg(*[REDUCERS[reducer](quoted(c)).alias(c) for c in columns])
    nested = group_nested(df.select(*[quoted(c) for c in (*keys, *columns)], ROW), *keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    return nested.select(*[quoted(k) for k in keys], *[F.aggregate(quoted(c), F.lit(None).cast(types[c]), reducer).alias(c) for c in columns])


def group_fold(df: DataFrame, keys: Sequence[str], step: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column], columns: Sequence[str] | None = None, *, bucket_rows: int = 10_000) -> DataFrame:
    """Fold the other columns per key with any function whose partial results can be merged.

    ``step(so far, value)`` folds the values of a stretch of ``bucket_rows`` row numbers,
    beginning with null; ``merge(a, b)`` joins the results of neighbouring stretches, in
    order.  Stretch after stretch, no task holds more than ``bucket_rows`` values of a
    key at once, however many it has.
    """
    columns = [c for c in df.columns if c not in keys and c != ROW] if columns is None else list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.agg(F.max(ROW)).first()[0] or 0
    out, fold, first = df.select(*[quoted(k) for k in keys], *[quoted(c) for c in columns], ROW), step, True
    while first or rows > 0:
        item = F.struct(quoted(ROW).alias("r"), *[quoted(c).alias(f"v{i}") for i, c in enumerate(columns)])
        place = F.floor(F.col(ROW) / bucket_rows).alias("__bucket")
        grouped = out.groupBy(*[quoted(k) for k in keys], place).agg(F.array_sort(F.collect_list(item)).alias("__items"))
        folded = []
        for i, c in enumerate(columns):
            if first:
                folded.append(F.aggregate(_part(i), F.lit(None).cast(types[c]), fold).alias(c))
            else:
                rest = F.slice(_part(i), 2, F.greatest(F.size("__items") - 1, F.lit(1)))
                folded.append(F.aggregate(F.when(F.size("__items") > 1, rest).otherwise(F.array().cast(T.ArrayType(types[c]))), F.get(_part(i), F.lit(0)), fold).alias(c))
        out = grouped.select(*[quoted(k) for k in keys], *folded, F.col("__bucket").alias(ROW))
        rows, fold, first = rows // bucket_rows, merge, False
    return out.drop(ROW)


def reduce_nested(df: DataFrame, reducer: Callable[[Column, Column], Column]) -> DataFrame:
    """Fold every array column without a seed; other columns stay, an empty array gives null."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, T.ArrayType):
            rest = F.when(F.size(c) > 1, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.array().cast(f.dataType))
            c = F.when(F.size(c) > 0, F.aggregate(rest, F.get(c, F.lit(0)), reducer)).alias(f.name)
        out.append(c)
    return df.select(*out)


def null_safe_sum(a: Column, b: Column) -> Column:
    """Reducer: null counts as zero."""
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def text_sum(c: Column) -> Column:
    """Aggregate: texts put together in the order given; null stands for "0"."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW), F.coalesce(c, F.lit("0")).alias("t")))), lambda x: x["t"]), "")


def vector_sum(c: Column, kind: str = "double") -> Column:
    """Sum of an array; 0 for an empty one, nulls left out."""
    return F.aggregate(F.transform(c, lambda x: x.cast(kind)), F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x, F.lit(0).cast(kind)))


def row_index(df: DataFrame, *keys: str) -> DataFrame:
    """Per key the sorted row numbers (``rows``)."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.array_sort(F.collect_list(ROW)).alias("rows"))


def row_bounds(df: DataFrame, *keys: str) -> DataFrame:
    """Per key first and last row number and how many there are, without collecting them."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.min(ROW).alias("first_row"), F.max(ROW).alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def distinct_first_seen(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with the row they first appear in."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.min(ROW).alias(ROW))


def cluster_ordinal(df: DataFrame, *keys: str, name: str = "cluster") -> DataFrame:
    """Number of the row's key, counted by first appearance."""
    first = distinct_first_seen(df, *keys).withColumnRenamed(ROW, "__first")
    order = with_row(first, "__first").withColumnRenamed(ROW, name)
    condition = None
    right = order.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], name)
    for i, k in enumerate(keys):
        one = quoted(k).eqNullSafe(F.col(f"__k{i}"))
        condition = one if condition is None else condition & one
    return df.join(right, condition).drop(*[f"__k{i}" for i in range(len(keys))])


def cluster_labels(df: DataFrame, key: str, labels: DataFrame, label: str = "label") -> DataFrame:
    """Replace a key by the k-th label, k the ordinal of its cluster; ``labels`` has ``__row`` and the label."""
    numbered = cluster_ordinal(df, key)
    return numbered.join(labels.select(F.col(ROW).alias("cluster"), quoted(label).alias("__label")), "cluster", "left").withColumn(key, F.col("__label")).drop("__label", "cluster")


def value_range(df: DataFrame, *columns: str) -> DataFrame:
    """One row: smallest and largest value of each column (``<c>_min``, ``<c>_max``)."""
    return df.agg(*[x for c in columns for x in (F.min(quoted(c)).alias(f"{c}_min"), F.max(quoted(c)).alias(f"{c}_max"))])
