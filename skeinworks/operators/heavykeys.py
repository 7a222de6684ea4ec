"""Per-key totals that stay balanced when a few keys hold most of the rows.

Every input split is dictionary-encoded on its own and reduced with
``numpy.bincount`` into dense accumulator arrays: a key costs one array slot
per split however many rows it has, so the hottest key is as cheap as any
other.  The arrays travel as blocks (a block is a hash range of the keys) and
are summed block by block in a second, distributed step.  The driver only sees
one number: the estimated count of keys, from which the number of blocks
follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import only, quoted

#: Keys that one block of accumulators is meant to hold.
BLOCK_KEYS = 50_000
#: Distinct keys after which a split hands on its arrays and starts new ones.
FLUSH_KEYS = 200_000


class _Accumulators:
    """Dense arrays over a growing key dictionary."""

    def __init__(self, width: int):
        self.codes: dict[str, int] = {}
        self.rows = np.zeros(0, np.int64)
        self.counts = np.zeros((width, 0), np.int64)
        self.sums = np.zeros((width, 0), np.float64)

    def code(self, keys: Sequence[str]) -> np.ndarray:
        codes = self.codes
        at = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
        short = len(codes) - len(self.rows)
        if short > 0:
            grow = max(short, len(self.rows) // 2)
            self.rows = np.concatenate([self.rows, np.zeros(grow, np.int64)])
            pad = ((0, 0), (0, grow))
            self.counts, self.sums = np.pad(self.counts, pad), np.pad(self.sums, pad)
        return at

    def add_rows(self, at: np.ndarray, values: list[np.ndarray]) -> None:
        """Scatter-reduce one value per row; NaN stands for a missing value."""
        n = len(self.codes)
        self.rows[:n] += np.bincount(at, minlength=n)
        for i, v in enumerate(values):
            there = ~np.isnan(v)
            self.counts[i, :n] += np.bincount(at[there], minlength=n)
            self.sums[i, :n] += np.bincount(at[there], weights=v[there], minlength=n)

    def add_block(self, at: np.ndarray, rows, counts, sums) -> None:
        """Add a block whose keys are distinct, so plain indexed addition is a scatter."""
        self.rows[at] += rows
        for i in range(len(counts)):
            self.counts[i, at] += counts[i]
            self.sums[i, at] += sums[i]


def _split_schema(width: int) -> str:
    return "block int, keys array<string>, n array<bigint>" + "".join(f", c{i} array<bigint>, s{i} array<double>" for i in range(width))


def _blocks_of(acc: _Accumulators, blocks: int, width: int) -> Iterator[pa.RecordBatch]:
    if not acc.codes:
        return
    keys = np.array(list(acc.codes), dtype=object)
    of = (pd.util.hash_array(keys, categorize=False) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    offsets = pa.array(np.r_[starts, len(order)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(keys[order], pa.string())), pa.ListArray.from_arrays(offsets, pa.array(acc.rows[order]))]
    for i in range(width):
        lists += [pa.ListArray.from_arrays(offsets, pa.array(acc.counts[i, order])), pa.ListArray.from_arrays(offsets, pa.array(acc.sums[i, order]))]
    names = ["block", "keys", "n"] + [x for i in range(width) for x in (f"c{i}", f"s{i}")]
    yield pa.RecordBatch.from_arrays([pa.array(of[order][starts])] + lists, names=names)


def key_totals(df: DataFrame, key: str, values: Sequence[str] = (), *, trim: bool = True, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Row count and, for each value column, count and sum, of every key.

    Columns of the result: ``key`` (the name given, as string), ``n_rows``, and for
    each value column ``<v>_n`` and ``<v>_sum`` (double).

    * ``trim``: blanks around a key are not part of it.
    * A null key is a key of its own; its totals come out under null.
    * Null and NaN values count for ``n_rows`` only; a key without any value has
      ``<v>_n`` 0 and ``<v>_sum`` null.  Infinite values add up as IEEE says.
    * Repeated rows are rows.  An empty table gives an empty result.  Other columns
      are not read, whatever they are called.
    * ``block_keys`` bounds the accumulators of one reducing task (expected keys).
    """
    values, width = list(values), len(values)
    df = only(df, key, *values)
    text = quoted(key).cast("string")
    read = df.select((F.trim(text) if trim else text).alias("k"), *[quoted(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    distinct = df.select(F.approx_count_distinct(text)).first()[0]
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, -(-distinct // block_keys))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulators(width)
        nulls = np.zeros((1 + 2 * width,), np.float64)
        for batch in batches:
            encoded = pc.dictionary_encode(batch.column(0))
            at = acc.code(encoded.dictionary.to_pylist())
            here = pc.is_valid(encoded.indices).to_numpy(zero_copy_only=False)
            codes = at[pc.fill_null(encoded.indices, 0).to_numpy()] if len(at) else np.zeros(len(here), np.int64)
            columns = [pc.cast(batch.column(1 + i), pa.float64()).to_numpy(zero_copy_only=False) for i in range(width)]
            if not here.all():
                nulls[0] += (~here).sum()
                for i, v in enumerate(columns):
                    lost = v[~here]
                    lost = lost[~np.isnan(lost)]
                    nulls[1 + 2 * i] += len(lost)
                    nulls[2 + 2 * i] += lost.sum()
                codes, columns = codes[here], [v[here] for v in columns]
            acc.add_rows(codes, columns)
            if len(acc.codes) > FLUSH_KEYS:
                yield from _blocks_of(acc, blocks, width)
                acc = _Accumulators(width)
        yield from _blocks_of(acc, blocks, width)
        if nulls[0]:
            one = [pa.array([-1], pa.int32()), pa.array([[None]], pa.list_(pa.string())), pa.array([[int(nulls[0])]])]
            for i in range(width):
                one += [pa.array([[int(nulls[1 + 2 * i])]]), pa.array([[float(nulls[2 + 2 * i])]])]
            yield pa.RecordBatch.from_arrays(one, names=["block", "keys", "n"] + [x for i in range(width) for x in (f"c{i}", f"s{i}")])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulators(width)
        for batch in batches:
            for r in range(batch.num_rows):
                at = acc.code(batch.column(1)[r].values.to_pylist())
                number = [batch.column(2 + j)[r].values.to_numpy() for j in range(1 + 2 * width)]
                acc.add_block(at, number[0], number[1::2], number[2::2])
        n = len(acc.codes)
        if not n:
            return
        out = [pa.array(list(acc.codes), pa.string()), pa.array(acc.rows[:n])]
        for i in range(width):
            out += [pa.array(acc.counts[i, :n]), pa.array(acc.sums[i, :n], mask=acc.counts[i, :n] == 0)]
        table = pa.RecordBatch.from_arrays(out, names=["k", "n"] + [x for i in range(width) for x in (f"c{i}", f"s{i}")])
        for start in range(0, n, 65_536):
            yield table.slice(start, 65_536)

    summed = (
        read.mapInArrow(split, _split_schema(width))
        .repartitionById(blocks + 1, F.when(F.col("block") < 0, blocks).otherwise(F.col("block")))
        .mapInArrow(reduce, "k string, n bigint" + "".join(f", c{i} bigint, s{i} double" for i in range(width)))
    )
    names = [F.col("k").alias(key), F.col("n").alias("n_rows")]
    for i, v in enumerate(values):
        names += [F.col(f"c{i}").alias(f"{v}_n"), F.col(f"s{i}").alias(f"{v}_sum")]
    return summed.select(*names)


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys (trimmed, not null) that hold at least ``share`` of all rows.

    One column, the key.  Rows without a key count as rows of the whole; an empty
    table has no heavy key.
    """
    whole = df.count()  # of a Parquet table known from its footers
    return key_totals(df, key).where(quoted(key).isNotNull() & (F.col("n_rows") >= F.lit(whole) * F.lit(share))).select(quoted(key))
