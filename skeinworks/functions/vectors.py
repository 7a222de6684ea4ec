"""Arrays as vectors: what the column functions do under one set of names and rules.

Indices begin at 0, an index out of range gives null, and lengths follow the rule of
each function (the left, the shorter) instead of padding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vmap(a: Column, f: Callable[[Column], Column]) -> Column:
    """Apply to every element."""
    return F.transform(a, f)


def vmap_indexed(a: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Apply to element and index."""
    return F.transform(a, f)


def vgather(a: Column, indices: Column) -> Column:
    """Elements by 0-based index; out of range gives null."""
    return F.transform(indices, lambda i: F.get(a, i))


def vslice(a: Column, start: int, end: int) -> Column:
    """Elements ``start`` up to, not including, ``end``."""
    return F.slice(a, start + 1, max(0, end - start))


def vreverse(a: Column) -> Column:
    """From last to first."""
    return F.reverse(a)


def vconcat(*arrays: Column) -> Column:
    """One behind the other."""
    return F.concat(*arrays)


def vappend(a: Column, x: Column) -> Column:
    """One element more."""
    return F.array_append(a, x)


def vzip(a: Column, b: Column) -> Column:
    """Pairs by index, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def vzip_with(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Combine by index, as many as the left has."""
    return F.slice(F.zip_with(a, b, f), 1, F.size(a))


def vpairs(a: Column) -> Column:
    """Neighbours that do not overlap; an odd last one is dropped."""
    n = F.floor(F.size(a) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(a, i * 2).alias("a"), F.get(a, i * 2 + 1).alias("b")))
    return F.slice(pairs, 1, n)


def vsplit(a: Column, parts: int) -> Column:
    """``parts`` equal stretches, what is over in the last."""
    size = F.greatest(F.floor(F.size(a) / parts), F.lit(1)).cast("int")
    last = F.lit(parts - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * size + 1, F.when(i == last, F.greatest(F.size(a) - i * size, F.lit(0))).otherwise(size)))


def vflatten(a: Column) -> Column:
    """One level of nesting less."""
    return F.flatten(a)


def left(pairs: Column, first: str = "a") -> Column:
    """First parts of an array of structs."""
    return F.transform(pairs, lambda p: p[first])


def right(pairs: Column, second: str = "b") -> Column:
    """Second parts of an array of structs."""
    return F.transform(pairs, lambda p: p[second])


def to_map(pairs: Column) -> Column:
    """Array of pairs to map."""
    return F.map_from_entries(pairs)


def matrix_at(m: Column, *indices: int) -> Column:
    """Element of an array nested as deep as there are indices."""
    for i in indices:
        m = F.get(m, F.lit(i))
    return m


def vector(*values) -> Column:
    """An array of values or columns."""
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def mapping(**values) -> Column:
    """A map of named values or columns."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def tuple_of(*values: Column) -> Column:
    """A struct with the fields ``a``, ``b``, ``c``, ..."""
    return F.struct(*[v.alias("abcdefghijklmnopqrstuvwxyz"[i]) for i, v in enumerate(values)])


def swapped(pair: Column) -> Column:
    """A pair the other way round."""
    return F.struct(pair["b"].alias("a"), pair["a"].alias("b"))


def negated(pair: Column) -> Column:
    """A pair of numbers with both signs turned."""
    return F.struct((-pair["a"]).alias("a"), (-pair["b"]).alias("b"))


def letters(text: Column) -> Column:
    """The characters of a text as an array; of an empty one, none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def as_set(a: Column) -> Column:
    """Distinct elements, in the order in which they first stand."""
    return F.array_distinct(a)


def bit_places(number: Column) -> Column:
    """The places of the bits that are set in a number, from the lowest."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftright", number.cast("long"), i).bitwiseAND(F.lit(1)) == 1)
