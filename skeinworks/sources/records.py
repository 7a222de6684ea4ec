"""Binary tables of fixed-length, big-endian records with a side-car schema.

A table is a folder of record files ``part-*.bin`` and one ``table.meta``: two comment
lines, then start/end offsets, column names, type names.  A single file with its own
``.meta`` beside it is read as well.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.scalars import CODECS, codec_for
from skeinworks.operators.rows import ROW

#: Bytes of records that one reading task takes.
SPLIT_BYTES = 64 << 20
TEXT_WIDTH = 128


@dataclass(frozen=True)
class Layout:
    """Columns of a record: (name, type name, start, end)."""

    columns: tuple[tuple[str, str, int, int], ...]

    @property
    def length(self) -> int:
        return self.columns[-1][3]

    def text(self) -> str:
        spans = " ".join(f"{a} {b}" for _, _, a, b in self.columns)
        names = " ".join(n.replace(" ", "_") for n, *_ in self.columns)
        return "\n".join(["# format: coords names types, space-separated", "# big-endian fixed-length records", spans, names, " ".join(t for _, t, *_ in self.columns), ""])

    @staticmethod
    def parse(text: str) -> Layout:
        lines = [x for x in text.splitlines() if x.strip() and not x.startswith("# ")]
        spans = list(map(int, lines[0].split()))
        names, types = lines[1].split(), lines[2].split()
        return Layout(tuple((n, t, a, b) for n, t, a, b in zip(names, types, spans[::2], spans[1::2])))

    def dtype(self) -> np.dtype:
        kinds = []
        for _, t, a, b in self.columns:
            kinds.append({"IoString": f"S{b - a}", "IoInstant": np.dtype([("s", ">i8"), ("n", ">i4")])}.get(t, CODECS[t].dtype))
        return np.dtype({"names": [f"f{i}" for i in range(len(kinds))], "formats": kinds, "offsets": [a for _, _, a, _ in self.columns], "itemsize": self.length})


def layout_of(df: DataFrame, widths: dict[str, int] | None = None, text_width: int = TEXT_WIDTH) -> Layout:
    """Running offsets from the columns' sizes; booleans take a byte."""
    out, at = [], 0
    for name, kind in df.dtypes:
        if name == ROW:
            continue
        t = codec_for(kind)
        size = CODECS[t].size or (widths or {}).get(name, text_width)
        out.append((name, t, at, at + size))
        at += size
    return Layout(tuple(out))


def _to_records(batch: pa.RecordBatch, layout: Layout) -> bytes:
    out = np.zeros(batch.num_rows, layout.dtype())
    for i, (name, t, a, b) in enumerate(layout.columns):
        column = batch.column(batch.schema.get_field_index(name))
        if t == "IoString":
            cells = [(v or "").encode() for v in column.to_pylist()]
            long = max(map(len, cells), default=0)
            if long > b - a:
                raise ValueError(f"column {name}: a text of {long} bytes does not fit into {b - a}")
            out[f"f{i}"] = [c.ljust(b - a) for c in cells]
        elif t in ("IoFloat", "IoDouble"):
            out[f"f{i}"] = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        elif column.null_count:
            raise ValueError(f"column {name}: {t} can't store null")
        elif t == "IoLocalDate":
            out[f"f{i}"] = column.cast(pa.int32()).to_numpy()
        elif t == "IoInstant":
            micros = column.cast(pa.int64()).to_numpy()
            out[f"f{i}"]["s"], out[f"f{i}"]["n"] = micros // 1_000_000, micros % 1_000_000 * 1000
        else:
            out[f"f{i}"] = column.to_numpy(zero_copy_only=False)
    return out.tobytes()


def located(spark: SparkSession, path: str) -> str:
    """A path with its scheme: that of the session's default file system where it names none."""
    if "://" in path:
        return path
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def write_records(df: DataFrame, path: str, *, widths: dict[str, int] | None = None, text_width: int = TEXT_WIDTH) -> Layout:
    """Write a table, in row order where there is one; an existing one is an error.

    A text that is too long is an error; a null text is empty, a null float NaN, a null
    of another type an error.  Tasks write files of their own names; the driver gives
    the winners their final ones, so a repeated task leaves no records behind.
    """
    layout = layout_of(df, widths, text_width)
    uri = located(df.sparkSession, path)
    fs, base = FileSystem.from_uri(uri)
    if fs.get_file_info(f"{base}/table.meta").type != FileType.NotFound:
        raise FileExistsError(path)
    fs.create_dir(base, recursive=True)
    rows = (df.orderBy(ROW).drop(ROW) if ROW in df.columns else df).withColumn("__p", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, folder = FileSystem.from_uri(uri)
        name, n, part = f"{folder}/_{uuid.uuid4().hex}", 0, -1
        with there.open_output_stream(name) as f:
            for b in batches:
                if b.num_rows:
                    part = b.column(b.num_columns - 1)[0].as_py()
                    f.write(_to_records(b, layout))
                    n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], names=["part", "name", "n"])

    written = sorted((r[0], r[1], r[2]) for r in rows.mapInArrow(run, "part int, name string, n bigint").collect())  # a row per task
    kept = 0
    for _, name, n in written:
        if n:
            fs.move(name, f"{base}/part-{kept:06d}.bin")
            kept += 1
    for info in fs.get_file_info(FileSelector(base)):
        if info.base_name.startswith("_"):
            fs.delete_file(info.path)
    with fs.open_output_stream(f"{base}/table.meta") as f:
        f.write(layout.text().encode())
    return layout


def read_layout(spark: SparkSession, path: str) -> Layout:
    """The schema of a table folder or of a single record file."""
    fs, base = FileSystem.from_uri(located(spark, path))
    meta = f"{base}/table.meta" if fs.get_file_info(base).type == FileType.Directory else f"{base}.meta"
    with fs.open_input_stream(meta) as f:
        return Layout.parse(f.read().decode())


def read_records(spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, layout: Layout | None = None, exact_instants: bool = False) -> DataFrame:
    """Read a table with ``__row``; only ``columns`` are decoded.

    ``layout`` describes files that have no side-car schema, or overrules theirs.

    Names that occur again get a number behind them.  Instants are timestamps of
    microseconds, or with ``exact_instants`` structs of seconds and nanoseconds.  A last
    record that is cut off is left out.  Files are read in stretches of whole records.
    """
    layout = layout or read_layout(spark, path)
    names = _names(layout)
    wanted = list(names) if columns is None else list(columns)
    return _scan(spark, [(path, layout, [names.index(w) for w in wanted])], exact_instants).toDF(*wanted, ROW)


def _names(layout: Layout) -> list[str]:
    names: list[str] = []
    for n, *_ in layout.columns:
        k, name = 1, n
        while name.lower() in {x.lower() for x in names}:
            name, k = f"{n}_{k}", k + 1
        names.append(name)
    return names


def _files(spark: SparkSession, path: str, layout: Layout) -> list[tuple[str, int]]:
    """The record files of a table in order, with how many whole records each has."""
    fs, base = FileSystem.from_uri(located(spark, path))
    is_folder = fs.get_file_info(base).type == FileType.Directory
    files = sorted(i.path for i in fs.get_file_info(FileSelector(base)) if i.base_name.endswith(".bin")) if is_folder else [base]
    return [(f, fs.get_file_info(f).size // layout.length) for f in files]


def _pieces(files: list[tuple[str, int]], starts: list[int], first: int, end: int) -> list[tuple[str, int, int]]:
    """Where the rows ``first`` up to ``end`` are: files, the first record in each and how many.  ``starts``: each file's first row."""
    out = []
    for i in range(bisect_right(starts, first) - 1, bisect_left(starts, end)):
        a, b = max(first, starts[i]), min(end, starts[i + 1])
        if a < b:
            out.append((files[i][0], a - starts[i], b - a))
    return out


def _batches(fs: FileSystem, pieces: list[dict], length: int, size: int) -> Iterator[bytes]:
    """The records of pieces of files, ``size`` at a time."""
    held, have = [], 0
    for piece in pieces:
        with fs.open_input_file(piece["f"]) as h:
            done = 0
            while done < piece["n"]:
                take = min(size - have, piece["n"] - done)
                held.append(h.read_at(take * length, (piece["s"] + done) * length))
                have, done = have + take, done + take
                if have == size:
                    yield b"".join(held)
                    held, have = [], 0
    if have:
        yield b"".join(held)


def _scan(spark: SparkSession, tables: Sequence[tuple[str, Layout, list[int]]], exact: bool = False) -> DataFrame:
    """Columns c0, c1, ... of tables beside each other and ``__row``, as far as the shortest table goes.

    A table is its path, layout and the wanted columns' places.  A task reads a stretch of
    rows from all of them, which ends with a file of the widest.  The stretches are dealt
    out as an RDD, of unknown size: behind a shuffle the adaptive planner would take the
    few bytes of their list for the size of all that is read, and broadcast it in a join.
    """
    uri, layouts, at = located(spark, tables[0][0]), [t[1] for t in tables], [t[2] for t in tables]
    files = [_files(spark, path, layout) for path, layout, _ in tables]
    starts = [[0, *accumulate(n for _, n in f)] for f in files]
    total, lengths = min(s[-1] for s in starts), [x.length for x in layouts]
    per, widest = max(1, SPLIT_BYTES // sum(lengths)), starts[lengths.index(max(lengths))]
    stretches = []
    for a, b in zip(widest, widest[1:]):
        for first in range(a, min(b, total), per):
            end = min(first + per, b, total)
            stretches.append((first, [_pieces(f, s, first, end) for f, s in zip(files, starts)]))
    types = [layout.columns[i][1] for layout, own in zip(layouts, at) for i in own]
    kinds = ["struct<sec:bigint,nano:int>" if t == "IoInstant" and exact else CODECS[t].spark for t in types]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), f"{ROW} bigint"])
    dealt = spark.sparkContext.parallelize(stretches, max(1, len(stretches)))
    listed = spark.createDataFrame(dealt, "r bigint, pieces array<array<struct<f:string,s:bigint,n:bigint>>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, _ = FileSystem.from_uri(uri)
        for b in batches:
            for r, pieces in zip(*(c.to_pylist() for c in b.columns)):
                for raws in zip(*(_batches(there, p, layout.length, 50_000) for p, layout in zip(pieces, layouts))):
                    out = []
                    for raw, layout, own in zip(raws, layouts, at):
                        cells = np.frombuffer(raw, layout.dtype())
                        out += [_from_records(cells[f"f{i}"], layout.columns[i][1], exact) for i in own]
                    size = len(raws[0]) // layouts[0].length
                    out.append(pa.array(np.arange(r, r + size)))
                    r += size
                    yield pa.RecordBatch.from_arrays(out, names=[*(f"c{i}" for i in range(len(types))), ROW])

    return listed.mapInArrow(run, schema)


def _from_records(raw: np.ndarray, t: str, exact: bool) -> pa.Array:
    if t == "IoString":
        return pa.array([x.decode("utf-8", "replace").strip() for x in raw.tolist()], pa.string())
    if t == "IoInstant":
        s, n = raw["s"].astype(np.int64), raw["n"].astype(np.int64)
        if exact:
            return pa.StructArray.from_arrays([pa.array(s), pa.array(n.astype(np.int32))], names=["sec", "nano"])
        return pa.array(s * 1_000_000 + n // 1000).cast(pa.timestamp("us", "UTC"))
    native = raw.astype(raw.dtype.newbyteorder("="))
    if t == "IoLocalDate":
        return pa.array(native.astype(np.int32)).cast(pa.date32())
    return pa.array(native.astype(bool)) if t == "IoBoolean" else pa.array(native)


def write_sharded(df: DataFrame, path: str, **options) -> None:
    """One table per column, so that each can be read alone."""
    for c in df.columns:
        if c != ROW:
            write_records(df.select(c, ROW), f"{path}/{c}", **options)


def read_sharded(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The columns beside each other again, by row: rows of one place are read together, without a join."""
    if len(columns) == 1:
        return read_records(spark, f"{path}/{columns[0]}")
    layouts = [read_layout(spark, f"{path}/{c}") for c in columns]
    made = _scan(spark, [(f"{path}/{c}", layout, list(range(len(layout.columns)))) for c, layout in zip(columns, layouts)])
    return made.select(ROW, *made.columns[:-1]).toDF(ROW, *(n for layout in layouts for n in _names(layout)))
