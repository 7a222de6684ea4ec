"""Pivot, resample, one-hot, scaling and other changes of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.operators.rows import ROW, with_row
from skeinworks.session import quoted

#: Most columns a pivot or one-hot may make; more is an error, not a cut.
MOST_KEYS = 10_000


def _keys(df: DataFrame, axis: Sequence[str]) -> list[tuple]:
    """Distinct keys in order of first appearance (of value where there is no ``__row``)."""
    distinct = df.groupBy(*[quoted(a) for a in axis]).agg(F.min(ROW).alias("__first")) if ROW in df.columns else df.select(*[quoted(a) for a in axis]).distinct()
    rows = distinct.orderBy("__first" if ROW in df.columns else quoted(axis[0]), *[quoted(a) for a in axis]).limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: they can't become columns")
    return [tuple(r[a] for a in axis) for r in rows]


def _is(axis: Sequence[str], key: tuple) -> Column:
    out = F.lit(True)
    for a, v in zip(axis, key):
        out = out & quoted(a).eqNullSafe(F.lit(v))
    return out


def _label(axis: Sequence[str], key: tuple, fan: str) -> str:
    return "[" + ",".join(f"{a}={'null' if v is None else v}" for a, v in zip(axis, key)) + f"]:{fan}"


def pivot_sparse(df: DataFrame, keep: Sequence[str], axis: Sequence[str], fan_out: Sequence[str]) -> DataFrame:
    """Pivot without aggregation: a row per input row, a column per key and fan-out column.

    Columns are called ``[axis=value,...]:fan`` and stand in the order in which their
    keys first appear; a null key is a key.  Cells of other keys are null.
    """
    wide = [F.when(_is(axis, k), quoted(f)).alias(_label(axis, k, f)) for k in _keys(df, axis) for f in fan_out]
    return df.select(*[quoted(c) for c in keep], *wide, *([ROW] if ROW in df.columns else []))


def pivot_sum(df: DataFrame, keep: Sequence[str], axis: Sequence[str], fan_out: Sequence[str], *, drop_null_key: bool = False) -> DataFrame:
    """``pivot_sparse``, grouping by ``keep`` and summing, in one aggregation; sums of nothing are 0."""
    keys = [k for k in _keys(df, axis) if not (drop_null_key and all(v is None for v in k))]
    sums = [F.coalesce(F.sum(F.when(_is(axis, k), quoted(f))), F.lit(0)).alias(_label(axis, k, f)) for k in keys for f in fan_out]
    return df.groupBy(*[quoted(c) for c in keep]).agg(*sums)


def resample_daily(df: DataFrame, day: str) -> DataFrame:
    """Append a row for each day that is missing between the first and the last; other cells are null.

    With ``__row`` the new rows are numbered behind the others, by day.
    """
    span = df.agg(F.min(quoted(day).cast("date")).alias("a"), F.max(quoted(day).cast("date")).alias("b")).where("a IS NOT NULL")
    days = span.select(F.explode(F.sequence("a", "b")).alias(day))
    missing = days.join(df.select(quoted(day).cast("date").alias(day)).distinct(), day, "left_anti")
    base = df.withColumn(day, quoted(day).cast("date"))
    if ROW in df.columns:
        end = df.agg(F.max(ROW)).first()[0]
        missing = with_row(missing, day).withColumn(ROW, F.col(ROW) + F.lit(0 if end is None else end + 1))
    return base.unionByName(missing, allowMissingColumns=True)


def transpose_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows become columns, in long form: (``pos`` of the old column, ``at`` of the old row, ``value``)."""
    return df.select(F.col(ROW).alias("at"), F.posexplode(F.array(*[quoted(c) for c in columns])).alias("pos", "value")).select("pos", "at", "value")


def transpose_arrays(df: DataFrame, column: str) -> DataFrame:
    """An array per old position, over the rows in order."""
    long = df.select(ROW, F.posexplode(quoted(column)).alias("pos", "v"))
    return long.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW), "v"))), lambda x: x["v"]).alias(column))


def one_hot(df: DataFrame, columns: Sequence[str], drop: str | int = "first") -> DataFrame:
    """Every value of a column becomes a boolean column ``column=value``, in the values' order.

    ``drop``: ``first``, ``last``, a position, the name of a new column, or ``none``.  A
    column of a single value keeps it.  Null is a value, sorted first.
    """
    out = []
    for c in columns:
        values = [k[0] for k in sorted(_keys(df.select(quoted(c)), [c]), key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0))]
        names = [f"{c}={'null' if v is None else v}" for v in values]
        gone = {"first": 0, "last": len(values) - 1, "none": None}.get(drop, drop) if not isinstance(drop, int) else drop
        if isinstance(gone, str):
            gone = names.index(gone) if gone in names else None
        for i, (v, n) in enumerate(zip(values, names)):
            if i != gone or len(values) == 1:
                out.append(quoted(c).eqNullSafe(F.lit(v)).alias(n))
    return df.select(*([ROW] if ROW in df.columns else []), *out)


def packed_booleans(df: DataFrame) -> DataFrame:
    """Boolean columns in which all but true is false."""
    return df.select(*[F.coalesce(quoted(f.name), F.lit(False)).alias(f.name) if isinstance(f.dataType, T.BooleanType) else quoted(f.name) for f in df.schema.fields])


def normalize(df: DataFrame, column: str) -> DataFrame:
    """Replace a column by ``normalized:<column>``, last, scaled to 0..1; the range goes into its metadata.

    If all values are equal the result is NaN; null stays null.
    """
    low, high = df.agg(F.min(quoted(column)).cast("double"), F.max(quoted(column)).cast("double")).first()
    name, c = f"normalized:{column}", quoted(column).cast("double")
    scaled = F.lit(None).cast("double") if low is None else F.when(c.isNotNull(), F.lit(float("nan"))) if low == high else (c - F.lit(low)) / F.lit(high - low)
    rest = [quoted(x) for x in df.columns if x != column]
    return df.select(*rest, scaled.alias(name, metadata={"normalized_min": low, "normalized_max": high}))


def denormalize(df: DataFrame, column: str) -> DataFrame:
    """The inverse, from the range in the metadata of ``normalized:<column>``."""
    name = f"normalized:{column}"
    m = df.schema[name].metadata
    low, high = m["normalized_min"], m["normalized_max"]
    rest = [quoted(x) for x in df.columns if x != name]
    back = F.lit(low) if low == high else quoted(name) * F.lit(high - low) + F.lit(low)
    return df.select(*rest, (back if low is not None else F.lit(None).cast("double")).alias(column))


def scale(value: Column, low: Column | float, high: Column | float) -> Column:
    """Min-max scaling of a single value, as double."""
    return (value.cast("double") - low) / (F.lit(high) - F.lit(low))


def unscale(value: Column, low: float, high: float) -> Column:
    """The inverse of ``scale``."""
    return value * F.lit(high - low) + F.lit(low)


def sparse_vector(values: Column, size: int) -> Column:
    """An array of ``size`` from an int-keyed map; absent keys are null."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(values, i))
