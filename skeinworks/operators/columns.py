"""Projection and cell-wise operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.operators.rows import ROW
from skeinworks.session import quoted


def positions(df: DataFrame, *names: str) -> list[int]:
    """Where the named columns stand; the first of equal names.  A missing name is an error."""
    out = []
    for n in names:
        if n not in df.columns:
            raise KeyError(n)
        out.append(df.columns.index(n))
    return out


def positions_without(df: DataFrame, *names: str) -> list[int]:
    """Where the other columns stand."""
    gone = set(positions(df, *names))
    return [i for i in range(len(df.columns)) if i not in gone]


def select_at(df: DataFrame, *indices: int) -> DataFrame:
    """Columns by position: reorder, drop, repeat (a repeated name gets a number behind it)."""
    seen: dict[str, int] = {}
    out = []
    for i in indices:
        name = df.columns[i]
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(quoted(name).alias(name if not k else f"{name}_{k}"))
    return df.select(*out)


def select_named(df: DataFrame, *names: str) -> DataFrame:
    """Columns by name."""
    return select_at(df, *positions(df, *names))


def drop_named(df: DataFrame, *names: str) -> DataFrame:
    """All columns but these, in their order; a missing name is an error."""
    return select_at(df, *positions_without(df, *names))


def slice_columns(df: DataFrame, start: int, last: int) -> DataFrame:
    """Columns ``start`` to ``last``, both included."""
    return select_at(df, *range(start, last + 1))


def mirror(df: DataFrame) -> DataFrame:
    """Columns from last to first."""
    return df.select(*[quoted(c) for c in reversed(df.columns)])


def map_cells(df: DataFrame, f: Callable[[Column], Column], *, keep: Sequence[str] = (ROW,)) -> DataFrame:
    """Apply a column function to every cell."""
    return df.select(*[quoted(c) if c in keep else f(quoted(c)).alias(c) for c in df.columns])


def map_cells_python(df: DataFrame, f: Callable, to: str, *, keep: Sequence[str] = (ROW,)) -> DataFrame:
    """Apply any Python function of one value to every cell, in Arrow batches; the slow way."""
    run = F.pandas_udf(lambda s: s.map(f, na_action=None), to)
    return map_cells(df, lambda c: run(c), keep=keep)


def fill_missing(df: DataFrame, fill: float) -> DataFrame:
    """Null, NaN and infinity become ``fill``, in numbers and arrays of numbers; other columns stay."""

    def cell(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.FloatType, T.DoubleType)):
            lost = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            return F.when(lost, F.lit(fill).cast(t)).otherwise(c)
        if isinstance(t, T.NumericType):
            return F.coalesce(c, F.lit(fill).cast(t))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: cell(x, t.elementType))
        return c

    return df.select(*[quoted(f.name) if f.name == ROW else cell(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def only_type(df: DataFrame, kind: str) -> DataFrame:
    """Columns of exactly this Spark type keep their values, the others become null of it."""
    return df.select(*[quoted(f.name) if f.name == ROW or f.dataType.simpleString() == kind else F.lit(None).cast(kind).alias(f.name) for f in df.schema.fields])


def values_only(df: DataFrame, name: str = "cells") -> DataFrame:
    """Each row as one array of texts, without column labels."""
    return df.select(*([ROW] if ROW in df.columns else []), F.array(*[quoted(c).cast("string") for c in df.columns if c != ROW]).alias(name))


def flatten_cells(df: DataFrame, kind: str) -> DataFrame:
    """All cells row by row as one column ``value`` of a type, with ``__row`` and ``pos``."""
    cells = only_type(df, kind)
    return cells.select(ROW, F.posexplode(F.array(*[quoted(c) for c in df.columns if c != ROW])).alias("pos", "value"))


def relabel(df: DataFrame, names: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """New names, and casts (a value that does not fit becomes null)."""
    types = types or {}
    return df.select(*[(quoted(c).try_cast(types[c]) if c in types else quoted(c)).alias(names.get(c, c)) for c in df.columns])


def gather_map(values: Column, keys: Column) -> Column:
    """Values of a map column for an array of keys; a missing key is an error."""
    return F.transform(keys, lambda k: F.when(F.map_contains_key(values, k), F.element_at(values, k)).otherwise(F.raise_error(F.lit("no such key"))))
