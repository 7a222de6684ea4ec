"""Column profiles per load, and the loads whose column is unlike the others.

Statistics of a column chunk come from the file itself where they are exact and
enough: nulls and extrema from the footer, distinct values from the dictionary page.
Only chunks for which they are not enough are read: those of several loads, and those
whose values are neither all null, nor one value, nor (text) all of the right pattern.
A list of (row group, columns still needed) is dealt out to the tasks, which read just
these.  Either way a chunk ends as counts by class and cell, and as the smallest hashes
of its distinct values; both add up.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.session import fits_broadcast, is_plain_scan, only, quoted, stage
from skeinworks.sources.chunks import chunks_of, columns_of

#: Cells of a value's magnitude to one doubling, and the cell of an infinite one.
FINENESS, INFINITE = 16, 1 << 20
#: Hashes kept of the distinct values of a column and part: up to so many they are counted exactly.
DISTINCT = 8_192
#: Bytes of chunks that one task reads.
TASK_BYTES = 128 << 20
#: Rows of counts a task holds before it adds them up.
HELD = 400_000
CLASSES = ("null", "nan", "negative", "zero", "positive", "day", "right", "wrong")
_COUNTS = "column string, part bigint, class string, cell bigint, n bigint, lo double, hi double, hashes binary"
_PLAN = f"file string, row_group int, n_rows bigint, bytes bigint, needed array<string>, {_COUNTS}"


@dataclass(frozen=True)
class _Kinds:
    """What the columns are: numbers, dates, or texts with the regular expression a whole value must match."""

    numbers: tuple[str, ...]
    dates: tuple[str, ...]
    texts: dict[str, str]

    @property
    def all(self) -> list[str]:
        return [*self.numbers, *self.dates, *self.texts]

    def classify(self, column: str, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class (its number), cell and value of distinct values that are not null."""
        if column in self.texts:
            right = pc.match_substring_regex(values.cast(pa.string()), rf"\A(?:{self.texts[column]})\z").to_numpy(zero_copy_only=False)
            return np.where(right, CLASSES.index("right"), CLASSES.index("wrong")), np.zeros(len(values), np.int64), np.full(len(values), np.nan)
        if column in self.dates:
            day = values.cast(pa.date32()).cast(pa.int32()).to_numpy().astype(np.int64) if not pa.types.is_timestamp(values.type) else pc.floor(pc.divide(values.cast(pa.timestamp("us", values.type.tz)).cast(pa.int64()).cast(pa.float64(), safe=False), 86_400e6)).to_numpy().astype(np.int64)
            return np.full(len(day), CLASSES.index("day")), day, day.astype(np.float64)
        v = values.cast(pa.float64(), safe=False).to_numpy()
        with np.errstate(all="ignore"):
            size = np.floor(np.log2(np.abs(v)) * FINENESS + 0.5)
            kind = np.select([np.isnan(v), v < 0, v == 0], [1, 2, 3], 4)
        cell = np.where(np.isinf(v), INFINITE, np.where((v == 0) | np.isnan(v), 0, np.where(np.isfinite(size), size, 0))).astype(np.int64)
        return kind, cell, v


def _hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct values, alike wherever a value stands; 0.0 and -0.0 are one."""
    if pa.types.is_floating(values.type):
        return pd.util.hash_array(values.cast(pa.float64()).to_numpy() + 0.0)
    if pa.types.is_integer(values.type):
        return pd.util.hash_array(values.cast(pa.int64()).to_numpy())
    if pa.types.is_date(values.type):
        return pd.util.hash_array(values.cast(pa.int32()).to_numpy().astype(np.int64))
    if pa.types.is_timestamp(values.type):
        return pd.util.hash_array(values.cast(pa.timestamp("us", values.type.tz), safe=False).cast(pa.int64()).to_numpy())
    return pd.util.hash_array(np.array([x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in values.to_pylist()], dtype=object), categorize=False)


def smallest(*sketches: np.ndarray) -> np.ndarray:
    """The ``DISTINCT`` smallest of several sets of hashes, sorted."""
    return np.unique(np.concatenate(sketches))[:DISTINCT]


def estimate(sketch: np.ndarray) -> int:
    """Distinct values: exact below ``DISTINCT``, else from how close the smallest hashes lie (1.1 % standard error)."""
    return len(sketch) if len(sketch) < DISTINCT else round((DISTINCT - 1) / (float(sketch[DISTINCT - 1]) / 2.0**64))


class _Counter:
    """Counts and hashes of what a task has read."""

    def __init__(self, kinds: _Kinds, distinct: bool):
        self.kinds, self.distinct = kinds, distinct
        self.pieces: list[pd.DataFrame] = []
        self.rows = 0
        self.sketches: dict[tuple[str, int | None], np.ndarray] = {}

    def add(self, column: str, part: pa.ChunkedArray | pa.Array, values: pa.ChunkedArray | pa.Array) -> None:
        """The values of a column, and the part of each."""
        parts, p = _encoded(part, "encode")
        words, v = _encoded(values, "mask")
        wide = len(words) + 1
        packed = p * wide + v + 1  # 0: null
        if len(parts) * wide <= 8 * len(packed) + 1024:
            n = np.bincount(packed, minlength=len(parts) * wide)
            met = np.flatnonzero(n)
            n = n[met]
        else:
            met, n = np.unique(packed, return_counts=True)
        of, at = met // wide, met % wide - 1
        kind, cell, value = self.kinds.classify(column, words)
        null = at < 0
        kind, cell, value = (np.append(y, x)[np.where(null, len(y), at)] for x, y in ((0, kind), (0, cell), (np.nan, value)))
        known = parts.is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(parts.cast(pa.int64()), 0).to_numpy()
        self._hold(pd.DataFrame({"column": column, "known": known[of], "part": ids[of], "class": kind, "cell": cell, "n": n, "lo": value, "hi": value}))
        if self.distinct and len(words):
            h, there = _hashes(words), ~null
            for i in np.unique(of[there]):
                self.sketch(column, parts[int(i)].as_py(), h[at[there & (of == i)]])

    def sketch(self, column: str, part: int | None, hashes: np.ndarray) -> None:
        key = (column, part)
        self.sketches[key] = smallest(self.sketches[key], hashes) if key in self.sketches else smallest(hashes)

    def hold(self, column: str, part: int, kind: str, cell: int, n: int, lo: float | None, hi: float | None) -> None:
        """Counts known without reading."""
        self._hold(pd.DataFrame({"column": [column], "known": [True], "part": [part], "class": [CLASSES.index(kind)], "cell": [cell], "n": [n], "lo": [np.nan if lo is None else lo], "hi": [np.nan if hi is None else hi]}))

    def _hold(self, piece: pd.DataFrame) -> None:
        self.pieces.append(piece)
        self.rows += len(piece)
        if self.rows > HELD:
            self.pieces = [self._summed()]
            self.rows = len(self.pieces[0])

    def _summed(self) -> pd.DataFrame:
        return pd.concat(self.pieces).groupby(["column", "known", "part", "class", "cell"], as_index=False).agg({"n": "sum", "lo": "min", "hi": "max"})

    def batches(self) -> Iterator[list[pa.Array]]:
        """What was counted, as the columns of ``_COUNTS``."""
        t = self._summed() if self.pieces else pd.DataFrame()
        for a in range(0, len(t), 50_000):
            x = t[a : a + 50_000]
            ends = [pa.array(x[c].to_numpy(), pa.float64(), mask=np.isnan(x[c].to_numpy())) for c in ("lo", "hi")]
            part = pa.array(x["part"].to_numpy(), pa.int64(), mask=~x["known"].to_numpy(bool))
            yield [pa.array(x["column"], pa.string()), part, pa.array([CLASSES[i] for i in x["class"]], pa.string()), pa.array(x["cell"].to_numpy(), pa.int64()), pa.array(x["n"].to_numpy(), pa.int64()), *ends, pa.nulls(len(x), pa.binary())]
        keys = list(self.sketches)
        for a in range(0, len(keys), 200):
            some = keys[a : a + 200]
            nothing = [pa.nulls(len(some), k) for k in (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.int64()), *nothing, pa.array([self.sketches[k].tobytes() for k in some], pa.binary())]


def _encoded(column: pa.ChunkedArray | pa.Array, nulls: str) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and for each row which it is, -1 for null unless null is a value."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    d = c.dictionary_encode(null_encoding=nulls)
    if isinstance(d, pa.ChunkedArray):
        d = d.unify_dictionaries().combine_chunks()
    return d.dictionary, pc.fill_null(d.indices, -1).to_numpy().astype(np.int64)


_NAMES = ["column", "part", "class", "cell", "n", "lo", "hi", "hashes"]


def _days(x) -> int:
    if isinstance(x, datetime.datetime):
        x = x.date()
    return (x - datetime.date(1970, 1, 1)).days


def _known(counter: _Counter, kinds: _Kinds, k) -> bool:
    """Count a chunk by what the file says about it, if that is enough."""
    if k.part is None or k.nulls is None:
        return False
    part, left, found = int(k.part), k.n_rows - k.nulls, None
    if left:
        if k.column in kinds.dates:
            if k.lowest is None or _days(k.lowest) != _days(k.highest) or (counter.distinct and k.lowest != k.highest):
                return False
            day = _days(k.lowest)
            found, values = ("day", day, left, float(day), float(day)), pa.array([k.lowest])
        elif k.dictionary is None or not len(k.dictionary):
            return False
        elif k.column in kinds.texts:
            values = pa.array([w.decode("utf-8", "replace") for w in k.dictionary])
            if (kinds.classify(k.column, values)[0] != CLASSES.index("right")).any():
                return False
            found = ("right", 0, left, None, None)
        else:
            values = pa.array(np.asarray(k.dictionary))
            if len(values) != 1:
                return False
            (kind,), (cell,), (v,) = kinds.classify(k.column, values)
            found = (CLASSES[kind], int(cell), left, float(v), float(v))
        counter.hold(k.column, part, *found)
        if counter.distinct:
            counter.sketch(k.column, part, _hashes(values))
    if k.nulls:
        counter.hold(k.column, part, "null", 0, k.nulls, None, None)
    return True


def chunk_plan(df: DataFrame, part: str, kinds: _Kinds, distinct: bool = False) -> DataFrame:
    """What the files say: counts of the chunks they know, and a row for each row group with the columns to be read (schema ``_PLAN``)."""
    spark = df.sparkSession
    files = df.inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    with_dictionary = [*kinds.numbers, *kinds.texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(kinds, distinct)
        names = ["file", "row_group", "n_rows", "bytes", "needed"]
        for b in batches:
            for uri in b.column(0).to_pylist():
                needed: dict[int, list] = {}
                for k in chunks_of(uri, part, kinds.all, with_dictionary):
                    if not _known(counter, kinds, k):
                        group = needed.setdefault(k.group, [k.n_rows, 0, []])
                        group[1] += k.size
                        group[2].append(k.column)
                if needed:
                    rows = [(uri, g, *x) for g, x in needed.items()]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())))]
                    nothing = [pa.nulls(len(rows), t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*arrays, *nothing], names=[*names, *_NAMES])
        for columns in counter.batches():
            n = len(columns[0])
            nothing = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*nothing, *columns], names=[*names, *_NAMES])

    return listed.mapInArrow(run, _PLAN)


def _read_groups(plan: DataFrame, part: str, kinds: _Kinds, distinct: bool) -> DataFrame:
    """Counts of the chunks that must be read."""
    wanted = plan.where("file IS NOT NULL").select("file", "row_group", "needed")
    groups, size = plan.where("file IS NOT NULL").agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(groups, max(plan.sparkSession.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(kinds, distinct)
        for b in batches:
            for uri, group, needed in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    table = pq.ParquetFile(f).read_row_group(group, columns=[*dict.fromkeys([part, *needed])], use_threads=False)
                for c in needed:
                    counter.add(c, table.column(part), table.column(c))
        for columns in counter.batches():
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return wanted.repartition(tasks, "file", "row_group").mapInArrow(run, _COUNTS)


def _scan(df: DataFrame, part: str, kinds: _Kinds, distinct: bool) -> DataFrame:
    """Counts of a table that is not just files: its rows go through the same counting."""
    names = kinds.all
    read = df.select(quoted(part).cast("long").alias("part"), *[quoted(c).cast("string") if c in kinds.texts else quoted(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(kinds, distinct)
        for b in batches:
            for i, c in enumerate(names):
                counter.add(c, b.column(0), b.column(1 + i))
        for columns in counter.batches():
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return read.mapInArrow(run, _COUNTS)


def _counted(df: DataFrame, part: str, numbers: Sequence[str], dates: Sequence[str], texts: dict[str, str] | None, distinct: bool) -> DataFrame:
    """Partial counts and sketches (schema ``_COUNTS``)."""
    kinds = _Kinds(tuple(numbers), tuple(dates), dict(texts or {}))
    df = only(df, part, *kinds.all)
    files = df.inputFiles() if is_plain_scan(df) else []
    if not files or not {part, *kinds.all} <= columns_of(files[0]):
        return _scan(df, part, kinds, distinct)
    plan = stage(chunk_plan(df, part, kinds, distinct))
    return _read_groups(plan, part, kinds, distinct).unionByName(plan.where("file IS NULL").select(_NAMES))


def _summed(counted: DataFrame) -> DataFrame:
    return counted.where("class IS NOT NULL").groupBy("column", "part", "class", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def column_counts(df: DataFrame, part: str, numbers: Sequence[str] = (), dates: Sequence[str] = (), texts: dict[str, str] | None = None) -> DataFrame:
    """(``column``, ``part``, ``class``, ``cell``, ``n``, ``lo``, ``hi``): counts of all values, known or read."""
    return _summed(_counted(df, part, numbers, dates, texts, False))


def _distinct(counted: DataFrame) -> DataFrame:
    """(``column``, ``part``, ``n_distinct``) of sketches, merged as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int | None], np.ndarray] = {}
        for b in batches:
            for column, part, raw in zip(*(c.to_pylist() for c in b.columns)):
                mine = np.frombuffer(raw, np.uint64)
                held[column, part] = smallest(held[column, part], mine) if (column, part) in held else mine
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array([estimate(x) for x in held.values()], pa.int64())], names=["column", "part", "n_distinct"])

    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.where("hashes IS NOT NULL").select("column", "part", "hashes").repartition(tasks, "column", "part").mapInArrow(run, "column string, part bigint, n_distinct bigint")


def column_profile(df: DataFrame, part: str, numbers: Sequence[str] = (), dates: Sequence[str] = (), texts: dict[str, str] | None = None) -> DataFrame:
    """A row per part and column: rows, shares, extrema, distinct values and pattern violations.

    ``texts`` maps text columns to the regular expression a whole value must match.
    Columns: ``column``, part (its name; null for rows without part), ``n_rows``,
    ``null_share``, ``nan_share``, ``negative_share``, ``zero_share``, ``lowest`` and
    ``highest`` (days since 1970-01-01 of dates; null for text; NaN left out),
    ``n_distinct`` (exact below ``DISTINCT`` values of a part, else within a few percent;
    NaN is a value, null is none) and ``n_violations``.

    Nulls in every column are counted as such; repeated rows count; infinite values are
    positive or negative ones; an empty table gives an empty result; columns not named
    are not read.
    """
    counted = stage(_counted(df, part, numbers, dates, texts, True))
    share = lambda k: (F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"{k}_share")
    rows = _summed(counted).groupBy("column", "part").agg(
        F.sum("n").alias("n_rows"), share("null"), share("nan"), share("negative"), share("zero"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"),
        F.sum(F.when(F.col("class") == "wrong", F.col("n")).otherwise(0)).alias("n_violations"),
    )
    both = rows.alias("a").join(_distinct(counted).alias("b"), (F.col("a.column") == F.col("b.column")) & F.col("a.part").eqNullSafe(F.col("b.part")), "left")
    names = ["n_rows", "null_share", "nan_share", "negative_share", "zero_share", "lowest", "highest"]
    return both.select("a.column", F.col("a.part").alias(part), *[f"a.{c}" for c in names], F.coalesce("b.n_distinct", F.lit(0)).alias("n_distinct"), "a.n_violations")


@dataclass(frozen=True)
class Steps:
    """How far a figure of a load must be from the others' to make a case.

    ``share`` and ``shape``: differences of a share, and of a whole distribution, that
    make a case in a load of any size; ``deviations``: how many robust standard
    deviations of the loads it must be besides.  ``floor``: the least difference that
    makes a case in a load large enough for it to be no chance, which is so many
    standard errors and rows: of a share (``share_chance``), of a level of a
    distribution (``level_chance``) and of its ends (``end_chance``).
    """

    share: float
    shape: float
    deviations: float
    floor: float
    share_chance: tuple[float, float]
    level_chance: tuple[float, float]
    end_chance: tuple[float, float]


_LEVELS = 32
#: Levels at the ends of a distribution, where few values of an ordinary load lie.
_ENDS = (0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998)


def _shares(counts: DataFrame, periods: DataFrame, low_day: int, high_day: int) -> DataFrame:
    """(``column``, ``part``, ``what``, ``x``, ``n``): the shares that are compared over the loads, and of how many rows."""
    total = counts.groupBy("column", "part").agg(F.sum("n").alias("n_all"))
    kinds = counts.join(F.broadcast(periods) if fits_broadcast(periods, 100_000) else periods, "part", "left")
    day = F.col("cell")
    where = (
        F.when(F.col("class") != "day", F.col("class"))
        .when((day < low_day) | (day > high_day), "outside")
        .when(day < F.col("first_day"), "earlier")
        .when(day >= F.col("next_day"), "later")
        .otherwise("inside")
    )
    classes = kinds.groupBy("column", "part", where.alias("what")).agg(F.sum("n").alias("n"))
    # The cell that holds most beyond its usual share: of zero and NaN the class itself speaks.
    heavy = counts.where("class IN ('positive', 'negative', 'day')").join(total, ["column", "part"]).withColumn("share", F.col("n") / F.col("n_all"))
    lists = heavy.groupBy("column", "class", "cell").agg(F.sort_array(F.collect_list("share"), asc=False).alias("xs"))  # at most as long as there are loads
    loads = counts.groupBy("column").agg(F.countDistinct("part").alias("n_loads"))
    usual = lists.join(F.broadcast(loads), "column").select("column", "class", "cell", F.coalesce(F.get("xs", F.expr("int(n_loads div 2)")), F.lit(0.0)).alias("u"))
    heaviest = heavy.join(usual, ["column", "class", "cell"]).groupBy("column", "part").agg(F.max(F.col("share") - F.col("u")).alias("x")).withColumn("what", F.lit("repeated"))
    names = counts.select("column", "part").distinct().join(F.broadcast(classes.select("column", "what").distinct()), "column")
    shares = names.join(classes, ["column", "part", "what"], "left").join(total, ["column", "part"]).select("column", "part", "what", (F.coalesce("n", F.lit(0)) / F.col("n_all")).alias("x"), F.col("n_all").alias("n"))
    repeated = total.join(heaviest, ["column", "part"], "left").select("column", "part", F.lit("repeated").alias("what"), F.greatest(F.coalesce("x", F.lit(0.0)), F.lit(0.0)).alias("x"), F.col("n_all").alias("n"))
    return shares.unionByName(repeated)


def _shapes(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(``column``, ``part``, ``what``, ``x``, ``n``): each load's distribution, and of how many values.

    ``distribution`` is its greatest distance from the usual one, which is, at each of
    ``_LEVELS`` cells chosen by the pooled counts, the median over the loads.
    ``distribution i`` and ``range i`` are its values at these levels and at those of
    ``_ENDS``; ``range below`` and ``range above`` the shares outside the usual extrema.
    """
    values = counts.where(F.col("class").isin(*classes))
    pooled = values.groupBy("column", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("column")  # at most as many rows as there are cells
    places = [(f"distribution {i}", i / _LEVELS) for i in range(1, _LEVELS)] + [(f"range {q}", q) for q in _ENDS]
    below = pooled.select("column", "cell", (F.sum("n").over(group.orderBy("cell")) / F.sum("n").over(group)).alias("q"))
    ends = values.groupBy("column", "part").agg(F.min("cell").alias("least"), F.max("cell").alias("most")).groupBy("column").agg(F.percentile_approx("least", 0.5, 10_000).alias("least"), F.percentile_approx("most", 0.5, 10_000).alias("most"))
    binned = values.join(below, ["column", "cell"]).join(F.broadcast(ends), "column")
    within = [*[(what, F.col("q") <= q) for what, q in places], ("range below", F.col("cell") < F.col("least")), ("range above", F.col("cell") > F.col("most"))]
    sums = binned.groupBy("column", "part").agg(F.sum("n").alias("n_all"), *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"b{i}") for i, (_, c) in enumerate(within)])
    curve = sums.select("column", "part", F.col("n_all").alias("n"), F.explode(F.array(*[F.struct(F.lit(what).alias("what"), (F.col(f"b{i}") / F.col("n_all")).alias("x")) for i, (what, _) in enumerate(within)])).alias("y")).select("column", "part", "y.what", "y.x", "n")
    middle = curve.where("what LIKE 'distribution %'")
    usual = middle.groupBy("column", "what").agg(F.percentile_approx("x", 0.5, 10_000).alias("u"))
    whole = middle.join(usual, ["column", "what"]).groupBy("column", "part").agg(F.max(F.abs(F.col("x") - F.col("u"))).alias("x"), F.first("n").alias("n")).withColumn("what", F.lit("distribution"))
    return curve.unionByName(whole)


def unlike_loads(df: DataFrame, part: str, numbers: Sequence[str], dates: Sequence[str], periods: DataFrame, steps: Steps, *, days: tuple[int, int] | None = None) -> DataFrame:
    """(part, ``column_name``, ``reasons``): the loads in which a column is not like in the others.

    Compared over all loads are the shares of null, NaN, negative, zero and positive
    values and of the one most repeated beyond its usual share, the distribution of the
    positive values (as a whole, at each of its levels, and at its ends and beyond the
    usual extrema: reason ``range``), and for dates the shares of days within the load's
    period, before and after it, and outside ``days``.
    A load stands out when a figure is further from the median of the loads than
    ``steps.deviations`` robust standard deviations (1.4826 x median absolute deviation)
    and than a step: ``steps.floor``, or what chance allows in a load of its size if that
    is more (for shares at most ``steps.share``); ``steps.share`` for a date's place by
    the period, as how much comes late changes over time; ``steps.shape`` for a
    distribution as a whole.

    ``periods``: (``part``, ``first_day``, ``next_day``, as days since 1970-01-01), the
    time a load is about; loads it leaves out have all their days inside.  ``days``: the
    first and last day a date may have.

    Rows without part belong to no load.  A column that is null in every load is like
    itself.  An empty table, or a single load, gives no case.  Repeated rows count.
    """
    counts = stage(column_counts(df, part, numbers, dates).where("part IS NOT NULL"))
    low_day, high_day = days or (-(1 << 40), 1 << 40)
    figures = stage(_shares(counts, periods, low_day, high_day).unionByName(_shapes(counts.where(F.col("column").isin(*numbers)) if numbers else counts.where("false"), ["positive"])))
    middle = figures.groupBy("column", "what").agg(F.percentile_approx("x", 0.5, 10_000).alias("m"))
    spread = figures.join(F.broadcast(middle), ["column", "what"]).withColumn("gap", F.abs(F.col("x") - F.col("m")))
    usual = spread.groupBy("column", "what").agg((F.percentile_approx("gap", 0.5, 10_000) * 1.4826).alias("sd"))
    chance = lambda errors, rows: F.greatest(F.lit(steps.floor), errors * F.sqrt(F.col("m") * (1 - F.col("m")) / F.col("n")) + rows / F.col("n"))
    step = (
        F.when(F.col("what") == "distribution", steps.shape)
        .when(F.col("what").startswith("distribution"), chance(*steps.level_chance))
        .when(F.col("what").startswith("range"), chance(*steps.end_chance))
        .when(F.col("what").isin("inside", "earlier", "later"), steps.share)  # how much comes late is not the same all along
        .otherwise(F.least(F.lit(steps.share), chance(*steps.share_chance)))
    )
    odd = spread.join(F.broadcast(usual), ["column", "what"]).where((F.col("gap") >= step) & (F.col("gap") >= F.col("sd") * steps.deviations)).withColumn("what", F.substring_index("what", " ", 1))
    return odd.groupBy(F.col("part").alias(part), F.col("column").alias("column_name")).agg(F.array_sort(F.collect_set("what")).alias("reasons"))
