"""Percentiles by radix selection over mergeable digit histograms.

A number becomes a 64-bit integer of the same order (``order_key``), which is read in
digits of 16 bits.  The first digit is counted per entity, part (load, day, ...) and
measure: this histogram has at most 65,536 cells however many values there are, its
counts add up over parts, and with the extremes of its cells a value is known to
within 2**-7 (float) or 2**-4 (double) of itself.  Only cells that hold a target rank
and more than one value are followed: a further pass per digit counts just the values
in them, until the percentile is exact.

A split counts its rows in numpy, merges its own cells, and sends them packed, in
blocks: hash ranges of (entity, part) for the parts, of the entity for all parts
together.  A group is never more than its cells, so a hot entity is no larger than
65,536 of them for each measure, and its parts are spread over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.session import only, quoted, stage

#: Rows that are counted together before a split hands on its histogram.
FLUSH_ROWS = 400_000
#: Cells after which a merging task adds up what it has read so far.
MERGE_CELLS = 2_000_000
#: Bytes of input for which there is one block at least.
BLOCK_BYTES = 32 << 20
#: Tasks beyond which further blocks only cost; a task then merges more as it reads.
MOST_BLOCKS = 100_000
#: Upper bound, as a power of two, of the bits of the filter for followed cells (8 MB).
FILTER_BITS = 26
_TOP = np.uint64(1 << 63)
_PART = ["level", "k", "g", "m"]


def order_key(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers in the order of float32 or float64 values; -0.0 is 0.0.

    A float32 fills the upper half only, so that its first two digits say all.
    """
    if values.dtype == np.float32:
        bits = (values + np.float32(0)).view(np.int32)
        return np.where(bits < 0, ~bits, bits ^ np.int32(-(1 << 31))).view(np.uint32).astype(np.uint64) << np.uint64(32)
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def key_value(keys: np.ndarray, single: bool = False) -> np.ndarray:
    """The values of order keys, as doubles; ``single`` for keys of float32 values."""
    if single:
        bits = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return np.where(bits < 0, bits ^ np.int32(-(1 << 31)), ~bits).view(np.float32).astype(np.float64)
    return np.where(keys & _TOP, keys ^ _TOP, ~keys).view(np.float64)


def _texts(values: pa.Array) -> np.ndarray:
    """Hashes of the values of a dictionary, whatever their type; a null has its own."""
    return pd.util.hash_array(np.array(["\0null" if x is None else str(x) for x in values.to_pylist()], dtype=object), categorize=False)


def _mixed(*parts) -> np.ndarray:
    h = np.uint64(0)
    for x in parts:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def _encode(column) -> tuple[pa.Array, np.ndarray]:
    d = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode")
    if isinstance(d, pa.ChunkedArray):
        d = d.unify_dictionaries().combine_chunks()
    return d.dictionary, d.indices.to_numpy().astype(np.int64)


class _Cells:
    """Cells of histograms: codes of entity and part into their dictionaries, measure, smallest and largest key, count."""

    def __init__(self, entities: pa.Array, parts: pa.Array, e, p, m, lo, hi, n):
        self.entities, self.parts = entities, parts
        self.e, self.p, self.m, self.lo, self.hi, self.n = e, p, m, lo, hi, n

    def group(self, measures: int) -> np.ndarray:
        return (self.e * len(self.parts) + self.p) * measures + self.m

    def merged(self, measures: int) -> _Cells:
        """Cells of equal group and first digit as one; in the order of group and digit."""
        g, digit = self.group(measures), (self.lo >> np.uint64(48)).astype(np.int64)
        order = np.argsort(g << 16 | digit, kind="stable") if len(self.entities) * len(self.parts) * measures < 1 << 47 else np.lexsort((digit, g))
        g, digit = g[order], digit[order]
        start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])]) if len(g) else np.zeros(0, np.int64)
        at = order[start]
        if not len(g):
            return self
        return _Cells(
            self.entities, self.parts, self.e[at], self.p[at], self.m[at],
            np.minimum.reduceat(self.lo[order], start), np.maximum.reduceat(self.hi[order], start), np.add.reduceat(self.n[order], start),
        )

    def over_parts(self, measures: int) -> _Cells:
        return _Cells(self.entities, pa.nulls(1, self.parts.type), self.e, np.zeros_like(self.p), self.m, self.lo, self.hi, self.n).merged(measures)


def _counted(table: pa.Table, measures: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Entities in their order, parts, and for every value its group and order key."""
    entities, e = _encode(table.column(0))
    order = pc.sort_indices(entities).to_numpy()  # neighbours begin alike, so they pack well
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entities, e = entities.take(pa.array(order)), rank[e]
    parts, p = _encode(table.column(1))
    base = (e * len(parts) + p) * measures
    groups, keys = [], []
    for m in range(measures):
        v = table.column(2 + m).to_numpy()
        there = ~np.isnan(v)
        keys.append(order_key(v[there]))
        groups.append(base[there] + m)
    return entities, parts, np.concatenate(groups), np.concatenate(keys)


def _runs(group: np.ndarray, key: np.ndarray, shift: int, most: int) -> tuple[np.ndarray, ...]:
    """Group, smallest and largest key and count of the cells: equal group and key above ``shift`` bits."""
    if most < 1 << 32 and not (key & np.uint64(0xFFFFFFFF)).any():
        packed = np.sort(group.astype(np.uint64) << np.uint64(32) | key >> np.uint64(32))
        group, key = (packed >> np.uint64(32)).astype(np.int64), packed << np.uint64(32)
    else:
        order = np.lexsort((key, group))
        group, key = group[order], key[order]
    digit = key >> np.uint64(shift)
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
    end = np.r_[start[1:], len(key)]
    return group[start], key[start], key[end - 1], (end - start).astype(np.int64)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= FLUSH_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _row_cells(table: pa.Table, measures: int) -> _Cells:
    """The first-digit histogram of a stretch of rows."""
    entities, parts, group, key = _counted(table, measures)
    if not len(key):
        none = np.zeros(0, np.int64)
        return _Cells(entities, parts, none, none, none, key, key, none)
    group, lo, hi, n = _runs(group, key, 48, len(entities) * len(parts) * measures)
    at = group // measures
    return _Cells(entities, parts, at // len(parts), at % len(parts), group % measures, lo, hi, n)


def _values_of(keys: np.ndarray, m: np.ndarray, single: Sequence[bool]) -> np.ndarray:
    return np.where(np.array(single)[m], key_value(keys, True), key_value(keys))


def _summary_cells(table: pa.Table, single: Sequence[bool]) -> _Cells:
    """The cells that a stretch of a stored summary holds."""
    entities, e = _encode(table.column("k"))
    parts, p = _encode(table.column("g"))
    m, n = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "n"))
    with np.errstate(over="ignore"):
        lo, hi = (np.where(np.array(single)[m], order_key(x.astype(np.float32)), order_key(x)) for x in (table.column(c).to_numpy() for c in ("lo", "hi")))
    return _Cells(entities, parts, e, p, m, lo, hi, n).merged(len(single))


def _blocks(cells: _Cells, level: int, blocks: int) -> Iterator[tuple]:
    """(block, level, parts, packed entities and cells) of a split's histogram."""
    if not len(cells.n):
        return
    hashed = _texts(cells.entities)[cells.e]
    if level == 0:
        hashed = _mixed(hashed, _texts(cells.parts)[cells.p])
    block = (_mixed(hashed) >> np.uint64(16)) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
    for a, z in zip(edge, np.r_[edge[1:], len(order)]):
        at = order[a:z]
        e, e_local = np.unique(cells.e[at], return_inverse=True)
        p, p_local = np.unique(cells.p[at], return_inverse=True)
        wide = cells.hi[at] != cells.lo[at]
        keys = cells.entities.take(pa.array(e))
        letters = b"".join(x.encode() for x in keys.to_pylist())
        arrays = [pc.binary_length(keys).to_numpy().astype(np.uint32), e_local.astype(np.uint32), p_local.astype(np.uint32), cells.m[at].astype(np.uint16), cells.lo[at], wide, cells.hi[at][wide], cells.n[at]]
        raw = b"".join([letters, *(x.tobytes() for x in arrays)])
        yield int(block[at[0]]), level, cells.parts.take(pa.array(p)), np.array([len(letters), len(keys), len(at), int(wide.sum()), len(raw)]).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    letters, keys, n, wide, size = (int(x) for x in np.frombuffer(data, np.int64, 5))
    raw, at, out = pa.decompress(data[40:], size, "zstd", asbytes=True), letters, []
    for kind, count in (("u4", keys), ("u4", n), ("u4", n), ("u2", n), ("u8", n), ("?", n), ("u8", wide), ("i8", n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    lengths, e, p, m, lo, is_wide, hi_of_wide, count = out
    offsets = np.zeros(keys + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    hi = lo.copy()
    hi[is_wide] = hi_of_wide
    entities = pa.StringArray.from_buffers(keys, pa.py_buffer(offsets), pa.py_buffer(raw[:letters]))
    return entities, [e.astype(np.int64), p.astype(np.int64), m.astype(np.int64), lo, hi, count]


def _merge(batches: Iterator[pa.RecordBatch], part_type: pa.DataType, measures: int) -> dict[int, _Cells]:
    """All cells of a task's blocks, merged, by level."""
    held: dict[int, _Cells] = {}
    waiting: dict[int, list] = {}

    def settle(level: int) -> None:
        parts = waiting.pop(level, [])
        if level in held:
            h = held[level]
            parts.insert(0, (h.entities, h.parts, [h.e, h.p, h.m, h.lo, h.hi, h.n]))
        if not parts:
            return
        entities, e_code = _encode(pa.concat_arrays([x[0] for x in parts]))
        groups, p_code = _encode(pa.concat_arrays([x[1] for x in parts]))
        e_at, p_at, columns = 0, 0, []
        for k, g, (e, p, *rest) in parts:
            columns.append([e_code[e_at + e], p_code[p_at + p], *rest])
            e_at, p_at = e_at + len(k), p_at + len(g)
        held[level] = _Cells(entities, groups, *(np.concatenate(c) for c in zip(*columns))).merged(measures)

    counts = {0: 0, 1: 0}
    for b in batches:
        for i in range(b.num_rows):
            level = b.column(1)[i].as_py()
            entities, cells = _unpacked(b.column(3)[i].as_py())
            waiting.setdefault(level, []).append((entities, b.column(2)[i].values.cast(part_type), cells))
            counts[level] += len(cells[0])
            if counts[level] > MERGE_CELLS:
                settle(level)
                counts[level] = 0
    for level in list(waiting):
        settle(level)
    return held


def _struct_of(permille: Sequence[int]) -> str:
    return "array<struct<prefix:bigint," + ",".join(f"r{q}:bigint" for q in permille) + ">>"


def _selected(cells: _Cells, level: int, measures: int, single: Sequence[bool], permille: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """A row for each group: its percentiles from its cells, and the cells left open."""
    g = cells.group(measures)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    end = np.r_[start[1:], len(g)]
    upto = np.cumsum(cells.n)
    before = np.r_[0, upto][start]
    total = upto[end - 1] - before
    lo, hi = _values_of(cells.lo, cells.m, single), _values_of(cells.hi, cells.m, single)
    same = lo == hi
    with np.errstate(invalid="ignore"):
        middle = np.where(same, lo, lo / 2 + hi / 2)
        bound = np.where(same, 0.0, np.maximum(hi - middle, middle - lo) * (1 + 2.0**-40))
    columns, at = [], []
    for q in permille:
        rank = np.maximum(1, (total * q + 999) // 1000)
        at.append(np.searchsorted(upto, before + rank, "left"))
        columns.append(middle[at[-1]])
    worst = np.max([bound[a] for a in at], axis=0)
    # Each open cell once, with the ranks that fall into it.
    picked = np.stack(at, axis=1)
    ranks = np.stack([np.maximum(1, (total * q + 999) // 1000) + before for q in permille], axis=1) - np.r_[0, upto][picked]
    flat_group, flat_cell = np.repeat(np.arange(len(start)), len(permille)), picked.reshape(-1)
    left = cells.lo[flat_cell] != cells.hi[flat_cell]
    cell, place = np.unique(flat_cell[left], return_inverse=True)
    inside = np.full((len(cell), len(permille)), -1, np.int64)
    inside[place, np.tile(np.arange(len(permille)), len(start))[left]] = ranks.reshape(-1)[left]
    owner = np.zeros(len(cell), np.int64)
    owner[place] = flat_group[left]
    offsets = np.searchsorted(owner, np.arange(len(start) + 1))
    structs = pa.StructArray.from_arrays(
        [pa.array((cells.lo[cell] >> np.uint64(48)).astype(np.int64)), *[pa.array(inside[:, i], mask=inside[:, i] < 0) for i in range(len(permille))]],
        names=["prefix", *[f"r{q}" for q in permille]],
    )
    names = ["level", "k", "g", "m", "n", *[f"q{q}" for q in permille], "bound", "left"]
    first = start
    for a in range(0, len(start), 20_000):
        z = min(len(start), a + 20_000)
        rows = slice(a, z)
        lists = pa.ListArray.from_arrays(pa.array((offsets[a : z + 1] - offsets[a]).astype(np.int32)), structs[int(offsets[a]) : int(offsets[z])])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(z - a, level, np.int32)),
                cells.entities.take(pa.array(cells.e[first[rows]])),
                cells.parts.take(pa.array(cells.p[first[rows]])),
                pa.array(cells.m[first[rows]].astype(np.int32)),
                pa.array(total[rows]),
                *[pa.array(c[rows]) for c in columns],
                pa.array(worst[rows]),
                lists,
            ],
            names=names,
        )


class _Measures:
    """What is read: the narrow table (k, g, v0, v1, ...) and the kinds of its values."""

    def __init__(self, df: DataFrame, entity: str, part: str | None, values: Sequence[str], trim: bool):
        df = only(df, entity, *([part] if part else []), *values)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for v in values:
            if not isinstance(kinds[v], T.NumericType):
                raise ValueError(f"column {v} is no number")
        self.single = [isinstance(kinds[v], (T.FloatType, T.ByteType, T.ShortType)) for v in values]
        #: Measures whose values a double may round.
        self.rounded = [isinstance(kinds[v], (T.LongType, T.DecimalType)) for v in values]
        self.part_type = kinds[part] if part else T.LongType()
        k = quoted(entity).cast("string")
        self.read = df.select(
            (F.trim(k) if trim else k).alias("k"),
            (quoted(part) if part else F.lit(None).cast("long")).alias("g"),
            *[quoted(v).cast("float" if s else "double").alias(f"v{i}") for i, (v, s) in enumerate(zip(values, self.single))],
        ).where("k IS NOT NULL")
        self.digits = 2 if all(self.single) else 4

    @property
    def arrow_part(self) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(self.part_type)


def _shuffled(df: DataFrame, measures: int, part_type: str, cells_of, levels: Sequence[int]) -> DataFrame:
    """Cells of every split, packed, in the partition of their block."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    at_least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(at_least, min(size // BLOCK_BYTES, MOST_BLOCKS) if size < 1 << 60 else 0)  # a size beyond that is none that is known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _flushes(batches):
            cells = cells_of(table, measures)
            for level in levels:
                rows = list(_blocks(cells if level == 0 else cells.over_parts(measures), level, blocks))
                for a in range(0, len(rows), 500):
                    block, of, parts, data = zip(*rows[a : a + 500])
                    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.concat_arrays(list(parts)))
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(of, pa.int32()), lists, pa.array(data, pa.binary())], names=["block", "level", "parts", "cells"])

    packed = df.mapInArrow(run, f"block int, level int, parts array<{part_type}>, cells binary")
    return packed.repartitionById(blocks, F.col("block"))


def digit_histogram(df: DataFrame, entity: str, part: str | None, values: Sequence[str], *, trim: bool = True) -> DataFrame:
    """The mergeable summary: (``k`` entity, ``g`` part, ``m`` measure no., ``c`` digit, ``n`` values, ``lo``, ``hi``), a row per cell.

    Summaries of different loads or days are combined by ``merge_histograms``, and
    ``percentiles_of`` reads percentiles from them.
    """
    what = _Measures(df, entity, part, values, trim)
    return _cell_rows(_shuffled(what.read, len(values), what.part_type.simpleString(), _row_cells, [0]), what.arrow_part, what.part_type.simpleString(), what.single)


def _cell_rows(packed: DataFrame, arrow_part: pa.DataType, part_type: str, single: Sequence[bool]) -> DataFrame:
    measures, single = len(single), list(single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _merge(batches, arrow_part, measures).values():
            for a in range(0, len(c.n), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [c.entities.take(pa.array(c.e[s])), c.parts.take(pa.array(c.p[s])), pa.array(c.m[s].astype(np.int32)), pa.array((c.lo[s] >> np.uint64(48)).astype(np.int32)), pa.array(c.n[s]), *[pa.array(_values_of(x[s], c.m[s], single)) for x in (c.lo, c.hi)]],
                    names=["k", "g", "m", "c", "n", "lo", "hi"],
                )

    return packed.mapInArrow(run, f"k string, g {part_type}, m int, c int, n bigint, lo double, hi double")


def merge_histograms(*summaries: DataFrame) -> DataFrame:
    """One summary of several: counts add up, extremes of a cell widen."""
    both = reduce(DataFrame.unionByName, summaries)
    return both.groupBy("k", "g", "m", "c").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _percentiles(packed: DataFrame, arrow_part: pa.DataType, part_type: str, single: Sequence[bool], permille: Sequence[int]) -> DataFrame:
    measures, single, permille = len(single), list(single), list(permille)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for level, c in _merge(batches, arrow_part, measures).items():
            if len(c.n):
                yield from _selected(c, level, measures, single, permille)

    return packed.mapInArrow(run, f"level int, k string, g {part_type}, m int, n bigint, " + ", ".join(f"q{q} double" for q in permille) + f", bound double, left {_struct_of(permille)}")


def percentiles_of(summary: DataFrame, values: Sequence[str], permille: Sequence[int] = (50, 250, 500, 750, 950, 990), *, single: Sequence[bool] | None = None) -> DataFrame:
    """Percentiles from a stored summary, for every part and for all parts merged, with ``error_bound``.

    ``values`` names the measures in the order of the summary; ``single`` says which of
    them were float (default: all), as 16-bit and 8-bit integers count.  Columns as in
    ``radix_percentiles``, with ``k`` and ``g``.
    """
    part = summary.schema["g"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    single = [True] * len(values) if single is None else list(single)
    packed = _shuffled(summary, len(values), part.simpleString(), lambda table, _: _summary_cells(table, single), [0, 1])
    return _named(_percentiles(packed, to_arrow_type(part), part.simpleString(), single, permille), "k", "g", values, permille)


def _named(found: DataFrame, entity: str, part: str | None, values: Sequence[str], permille: Sequence[int], rounded: Sequence[bool] = ()) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("m") + 1)
    bound = F.col("bound")
    if any(rounded):  # what a double does to a longer number
        largest = F.greatest(*[F.abs(F.col(f"q{q}")) for q in permille], F.lit(0.0))
        bound = F.when(F.col("m").isin([i for i, r in enumerate(rounded) if r]), bound + largest * 2.0**-53).otherwise(bound)
    out = [F.col("k").alias(entity)] + ([F.col("g").alias(part)] if part else [])
    return found.select(*out, (F.col("level") == 1).alias("all_parts"), name.alias("measure"), "n", *[F.col(f"q{q}").alias(f"p{q}") for q in permille], bound.alias("error_bound"))


def radix_percentiles(df: DataFrame, entity: str, part: str | None, values: Sequence[str], permille: Sequence[int] = (50, 250, 500, 750, 950, 990), *, exact: bool = True, trim: bool = True) -> DataFrame:
    """Percentiles of every measure per entity and part, and per entity over all parts.

    Columns: entity, part (null for all parts together) if one is named, ``all_parts``
    (true for these rows), ``measure``, ``n`` (values), ``p<permille>`` (a value of the
    data: the one of rank ``ceil(n * permille / 1000)``, as double) and ``error_bound``,
    which no percentile of the row is further from the true one than.  With ``exact`` it
    is 0, but for long and decimal values, which a double may round by 2**-53 of
    themselves; without, one pass is made and a value is wrong by at most half of its
    cell's extent, so by no more than 2**-8 (float) or 2**-5 (others) of itself.

    * Values are numbers of any type (others: ValueError): float and shorter are taken
      as 32-bit numbers, all others as doubles; the part may be of any type.
    * Null and NaN are no values; a group without values has no row.  Infinities are
      values at the ends.
    * Rows with a null entity are left out; with ``trim`` blanks around it do not
      count.  A null part is a part.  Ties and repeated rows count as often as they occur.
    * An empty table gives an empty result.  Only the named columns are read, so other
      columns may be called anything.
    """
    what = _Measures(df, entity, part, values, trim)
    kind = what.part_type.simpleString()
    levels = [0, 1] if part else [1]
    packed = _shuffled(what.read, len(values), kind, _row_cells, levels)
    found = _percentiles(packed, what.arrow_part, kind, what.single, permille)
    if exact:
        found = stage(found)
        answered = _follow(what, found, permille, levels)
        open_groups = found.where(F.size("left") > 0)
        better = open_groups.alias("a").join(answered.alias("b").hint("merge"), _same(_PART), "left")
        done = better.select(*[f"a.{x}" for x in _PART], "a.n", *[F.coalesce(f"b.q{q}", f"a.q{q}").alias(f"q{q}") for q in permille], F.lit(0.0).alias("bound"))
        found = found.where(F.size("left") == 0).select(done.columns).unionByName(done)
    return _named(found, entity, part, values, permille, what.rounded)


def _same(names: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in names])


def _place(level, k, g, m, prefix) -> np.ndarray:
    """The bit of the filter for a cell."""
    return _mixed(np.uint64(level), k, g, m.astype(np.uint64), prefix) >> np.uint64(64 - FILTER_BITS)


def _filter(open_: DataFrame) -> np.ndarray:
    """A bit table of the cells to follow."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (entities, e), (parts, p) = _encode(b.column(1)), _encode(b.column(2))
            level = b.column(0).to_numpy()
            g = np.where(level == 0, _texts(parts)[p], np.uint64(0))
            h = np.unique(_place(level.astype(np.uint64), _texts(entities)[e], g, b.column(3).to_numpy(), b.column(4).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((h & np.uint64(63)).astype(np.int32))], names=["word", "bit"])

    cells = open_.select(*_PART, "prefix")
    words = cells.mapInArrow(places, "word bigint, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()  # at most 2 ** (FILTER_BITS - 6) rows
    mask = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    mask[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return mask


def _next_digit(what: _Measures, mask: np.ndarray, digit: int, levels: Sequence[int]) -> DataFrame:
    """Histogram by digit number ``digit`` of the values whose digits so far are in the filter."""
    sent = what.read.sparkSession.sparkContext.broadcast(mask)  # at most 2 ** FILTER_BITS bits
    measures, single, shift = len(what.single), what.single, 64 - 16 * digit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for table in _flushes(batches):
            entities, parts, group, key = _counted(table, measures)
            if not len(key):
                continue
            of_entity, of_part = _texts(entities), _texts(parts)
            at = group // measures
            prefix = key >> np.uint64(shift + 16)
            for level in levels:
                h = _place(level, of_entity[at // len(parts)], of_part[at % len(parts)] if level == 0 else np.uint64(0), group % measures, prefix)
                hit = wanted[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1) == 1
                if not hit.any():
                    continue
                mine = group[hit] if level == 0 else group[hit] // (measures * len(parts)) * (measures * len(parts)) + group[hit] % measures
                g, lo, hi, n = _runs(mine, key[hit], shift, len(entities) * len(parts) * measures)
                m, of = g % measures, g // measures
                values = [_values_of(x, m, single) for x in (lo, hi)]
                part = parts.take(pa.array(of % len(parts))) if level == 0 else pa.nulls(len(g), parts.type)
                batch = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(g), level, np.int32)), entities.take(pa.array(of // len(parts))), part, pa.array(m.astype(np.int32)),
                        pa.array((lo >> np.uint64(shift + 16)).view(np.int64)), pa.array((lo >> np.uint64(shift)).view(np.int64)), pa.array(n), *map(pa.array, values),
                    ],
                    names=[*_PART, "prefix", "c", "n", "lo", "hi"],
                )
                for a in range(0, batch.num_rows, 50_000):
                    yield batch.slice(a, 50_000)

    cells = what.read.mapInArrow(run, f"level int, k string, g {what.part_type.simpleString()}, m int, prefix bigint, c bigint, n bigint, lo double, hi double")
    return cells.groupBy(*_PART, "prefix", "c").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _follow(what: _Measures, found: DataFrame, permille: Sequence[int], levels: Sequence[int]) -> DataFrame:
    """The exact values of the target ranks in the cells left open, digit after digit."""
    ranks = [f"r{q}" for q in permille]
    open_ = found.where(F.size("left") > 0).select(*_PART, F.explode("left").alias("x")).select(*_PART, "x.prefix", *[f"x.{r}" for r in ranks])
    answers = []
    for digit in range(2, what.digits + 1):
        mask = _filter(open_)
        if not mask.any():
            break
        cells = _next_digit(what, mask, digit, levels)
        group = Window.partitionBy(*_PART, "prefix")  # at most 65,536 cells
        upto = cells.withColumn("upto", F.sum("n").over(group.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))
        inside = [F.when((F.col(f"b.{r}") > F.col("a.upto") - F.col("a.n")) & (F.col(f"b.{r}") <= F.col("a.upto")), F.col(f"b.{r}") - (F.col("a.upto") - F.col("a.n"))).alias(r) for r in ranks]
        met = upto.alias("a").join(open_.alias("b").hint("merge"), _same([*_PART, "prefix"])).select(*[f"a.{x}" for x in _PART], F.col("a.c").alias("prefix"), "a.lo", "a.hi", *inside).where(F.coalesce(*ranks).isNotNull())
        if digit < what.digits:
            met = stage(met)
            open_ = met.where("lo < hi").drop("lo", "hi")
            met = met.where("lo = hi")
        answers.append(met)
    if not answers:
        return found.select(*_PART, *[F.col(f"q{q}") for q in permille]).where("false")
    both = reduce(DataFrame.unionByName, answers)
    return both.groupBy(*_PART).agg(*[F.max(F.when(F.col(f"r{q}").isNotNull(), F.col("lo"))).alias(f"q{q}") for q in permille])
