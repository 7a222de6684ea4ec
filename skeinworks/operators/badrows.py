"""Raw records to typed rows, with the records that do not parse set apart by reason.

A block of records is parsed in bulk on a vectorized path (Arrow's CSV reader, string
kernels and casts).  A block that fails is halved, again and again, down to the
single records at fault; only these go to a strict record parser, which says what is
wrong with them.  Whether a part of a block fails is known from prefix sums over masks
that are computed once for the block, so halving costs nothing per record.  The
Arrow path never accepts what the strict parser would refuse: where it can't be
sure, the record goes to the strict parser, which may still find it valid.
"""

from __future__ import annotations

import datetime
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import free_name, only, quoted, spread

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: Numbers the Arrow path reads: of a size no cast can object to.
_PLAIN_NUMBER = r"^(?:[+-]?(?:[0-9]{1,30}\.?[0-9]{0,60}|\.[0-9]{1,60})(?:[eE][+-]?[0-9]{1,2})?)?$"
_number, _date = re.compile(NUMBER), re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_EPOCH, _CYCLE = datetime.date(1970, 1, 1).toordinal(), 146_097
_ARROW = {"date": pa.date32(), "text": pa.string(), "float": pa.float32(), "double": pa.float64()}
_SPARK = {"date": "date", "text": "string", "float": "float", "double": "double"}
_NUMPY = {"float": np.float32, "double": np.float64}


@dataclass(frozen=True)
class Field:
    """A field: its name, its kind (``date``, ``text``, ``float`` or ``double``) and whether it must be filled."""

    name: str
    kind: str
    required: bool = False


@dataclass(frozen=True)
class RecordLayout:
    """How a record is written.

    ``spans``: for fixed-width records, the adjoining half-open character ranges of the
    fields and with them the exact length; None: separated by commas.
    """

    fields: tuple[Field, ...]
    spans: tuple[tuple[int, int], ...] | None = None

    def __post_init__(self):
        if not self.fields or {f.kind for f in self.fields} - set(_ARROW):
            raise ValueError(f"fields must be of the kinds {sorted(_ARROW)}")
        if self.spans and len(self.spans) != len(self.fields):
            raise ValueError("a fixed-width layout needs a span for each field")

    @property
    def length(self) -> int:
        return self.spans[-1][1] if self.spans else 0

    @property
    def shape(self) -> str:
        """A csv record of as many fields in which every quote is part of an enclosed field or its doubling."""
        one = r'(?:"(?:[^"]|"")*"|[^",]*)'
        return f"^{one}(?:,{one}){{{len(self.fields) - 1}}}$"


def split_csv(line: str) -> tuple[list[str], str | None]:
    """The fields of a csv record and, if it is malformed, why."""
    fields, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            part, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return fields, "unclosed quote"
                part.append(line[at:close])
                if line[close + 1 : close + 2] != '"':
                    at = close + 1
                    break
                part.append('"')
                at = close + 2
            fields.append("".join(part))
            if at < end and line[at] != ",":
                return fields, "text after closing quote"
        else:
            comma = line.find(",", at)
            stop = end if comma < 0 else comma
            if '"' in line[at:stop]:
                return fields, "stray quote"
            fields.append(line[at:stop])
            at = stop
        if at >= end:
            return fields, None
        at += 1


def day_number(text: str) -> int | None:
    """Days since 1970-01-01 of a real day written yyyy-MM-dd (years 0000 to 9999)."""
    if not _date.fullmatch(text):
        return None
    year = int(text[:4])
    try:  # year 0 has the calendar of year 400, a full cycle later
        n = datetime.date(year or 400, int(text[5:7]), int(text[8:])).toordinal() - _EPOCH
    except ValueError:
        return None
    return n if year else n - _CYCLE


def parse_strict(line: str | None, layout: RecordLayout) -> tuple[list, str | None]:
    """The values of one record (a date as day number), and the reason it fails (else None)."""
    nothing = [None] * len(layout.fields)
    if line is None:
        return nothing, "no record"
    if layout.spans:
        if len(line) != layout.length:
            return nothing, f"length is not {layout.length}"
        cells = [line[a:b] for a, b in layout.spans]
    else:
        cells, wrong = split_csv(line)
        if wrong:
            return nothing, wrong
        if len(cells) != len(layout.fields):
            return nothing, "too few fields" if len(cells) < len(layout.fields) else "too many fields"
    values = []
    for f, cell in zip(layout.fields, cells):
        cell = cell.strip(" ")
        value: object = cell
        if not cell:
            if f.required:
                return nothing, f"invalid {f.name}" if f.kind == "date" else f"empty {f.name}"
            value = None if f.kind != "text" else ""
        elif f.kind == "date":
            value = day_number(cell)
            if value is None:
                return nothing, f"invalid {f.name}"
        elif f.kind != "text":
            with np.errstate(over="ignore"):
                value = float(_NUMPY[f.kind](float(cell))) if _number.fullmatch(cell) else float("nan")
            if not np.isfinite(value):  # as the column holds it
                return nothing, f"invalid {f.name}"
        values.append(value)
    return values, None


def clean_stretches(bad: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Halve a block where it fails: its stretches with nothing bad, and the single bad records."""
    before = np.concatenate([[0], np.cumsum(bad)])
    clean, single, todo = [], [], [(0, len(bad))]
    while todo:
        a, z = todo.pop()
        if a == z:
            continue
        if before[a] == before[z]:
            if clean and clean[-1][1] == a:
                a = clean.pop()[0]
            clean.append((a, z))
        elif z - a == 1:
            single.append(a)
        else:
            middle = (a + z) // 2
            todo += [(middle, z), (a, middle)]
    return clean, single


def _true(mask) -> np.ndarray:
    """A mask as numpy, unknown being false."""
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _cells(lines: pa.Array, layout: RecordLayout) -> list[pa.Array] | None:
    """The trimmed fields of records of the right shape; None if the reader sees it otherwise."""
    if layout.spans:
        columns = [pc.utf8_slice_codeunits(lines, a, b) for a, b in layout.spans]
    else:
        names = [f"f{i}" for i in range(len(layout.fields))]
        text = "\n".join(lines.to_pylist()).encode() + b"\n"
        try:
            table = pcsv.read_csv(
                io.BytesIO(text),
                read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=len(text) + 1),
                parse_options=pcsv.ParseOptions(quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False),
                convert_options=pcsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
            )
        except pa.ArrowInvalid:
            return None
        if table.num_rows != len(lines):
            return None
        columns = [c.combine_chunks() for c in table.columns]
    return [pc.utf8_trim(c, " ") for c in columns]


def _days(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 of texts yyyy-MM-dd, and which of them are real days."""
    shaped = _true(pc.match_substring_regex(cells, "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    safe = pc.if_else(pa.array(shaped), cells, "2000-01-01")
    year, month, day = (pc.cast(pc.utf8_slice_codeunits(safe, a, z), pa.int64()).to_numpy() for a, z in ((0, 4), (5, 7), (8, 10)))
    first = ((year - 1970) * 12 + np.clip(month, 1, 12) - 1).astype("M8[M]")
    start, end = (m.astype("M8[D]").astype(np.int64) for m in (first, first + 1))
    return start + day - 1, shaped & (month >= 1) & (month <= 12) & (day >= 1) & (day <= end - start)


def _numbers(cells: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    """The numbers of texts (null where empty), and which of the texts are good."""
    shaped = _true(pc.match_substring_regex(cells, _PLAIN_NUMBER))
    filled = pa.array(shaped & _true(pc.not_equal(cells, "")))
    value = pc.cast(pc.replace_substring_regex(pc.if_else(filled, cells, None), r"^\+", ""), pa.float64()).cast(_ARROW[kind], safe=False)
    return value, shaped & _true(pc.fill_null(pc.is_finite(value), True))


def parse_bulk(lines: pa.Array, layout: RecordLayout) -> tuple[list[pa.Array], np.ndarray]:
    """The typed columns of a block, and which of its records are not plainly valid."""
    if layout.spans:
        good = _true(pc.equal(pc.utf8_length(lines), layout.length))
    else:  # the reader would take a line end inside a record for the record's own
        good = _true(pc.match_substring_regex(lines, layout.shape)) & ~_true(pc.match_substring_regex(lines, "[\r\n]"))
    clean, _ = clean_stretches(~good)
    columns = [pa.nulls(len(lines), _ARROW[f.kind]) for f in layout.fields]
    if not clean:
        return columns, ~good
    at = np.flatnonzero(good)
    cells = _cells(pa.concat_arrays([lines[a:z] for a, z in clean]), layout)
    if cells is None:  # not seen so far; each half is tried on its own, a single record is the strict parser's
        if len(lines) == 1:
            return columns, np.ones(1, bool)
        halves = [parse_bulk(part, layout) for part in (lines[: len(lines) // 2], lines[len(lines) // 2 :])]
        return [pa.concat_arrays(list(c)) for c in zip(*(h[0] for h in halves))], np.concatenate([h[1] for h in halves])
    place = np.full(len(lines), -1, np.int64)
    place[at] = np.arange(len(at))
    where = pa.array(np.where(place < 0, 0, place))
    for i, (f, cell) in enumerate(zip(layout.fields, cells)):
        full = _true(pc.not_equal(cell, ""))
        if f.kind == "date":
            days, right = _days(cell)
            value = pa.array(np.where(right, days, 0).astype(np.int32), mask=~full).cast(pa.date32())
            right |= ~full
        elif f.kind == "text":
            value, right = cell, np.ones(len(cell), bool)
        else:
            value, right = _numbers(cell, f.kind)
        if f.required:
            right &= full
        good[at[~right]] = False
        columns[i] = value.take(where)
    return columns, ~good


def parse_block(lines: pa.Array, layout: RecordLayout) -> tuple[list[pa.Array], pa.Array]:
    """The typed columns of a block and the reasons of the records that are none (else null)."""
    columns, bad = parse_bulk(lines, layout)
    clean, single = clean_stretches(bad)
    if not single:
        return columns, pa.nulls(len(lines), pa.string())
    judged = [parse_strict(x, layout) for x in lines.take(pa.array(single)).to_pylist()]
    order = np.empty(len(lines), np.int64)
    for a, z in clean:
        order[a:z] = np.arange(a, z)
    order[single] = len(lines) + np.arange(len(single))
    order = pa.array(order)
    out = []
    for i, f in enumerate(layout.fields):
        kind = pa.int32() if f.kind == "date" else _ARROW[f.kind]
        out.append(pa.concat_arrays([columns[i], pa.array([v[i] for v, _ in judged], kind).cast(_ARROW[f.kind])]).take(order))
    return out, pa.concat_arrays([pa.nulls(len(lines), pa.string()), pa.array([r for _, r in judged], pa.string())]).take(order)


def parse_records(df: DataFrame, raw: str, layout: str, layouts: dict[str, RecordLayout], keep: Sequence[str] = ()) -> DataFrame:
    """Parse the raw text column ``raw``; column ``layout`` names, row by row, one of ``layouts``.

    All layouts must have the same fields.  The result has the columns ``keep`` of the
    input, then the fields (null where empty or the record invalid; an empty text that
    need not be filled is empty) and ``reason``: null for a valid record, otherwise why
    it is none.  Every row comes out exactly once, valid or not.

    * A null record, or one of an unknown layout, is invalid; an empty one too.
    * Blanks (spaces) around a field do not count.  A date is a real day written
      yyyy-MM-dd; a number is decimal and finite in the field's type, so one too large
      for it is invalid.  Very long records are parsed whole.
    * Repeated records are parsed each on its own.  ``keep`` may name any column, but
      none of the result's (ValueError).  An empty table gives an empty result.
    """
    fields = next(iter(layouts.values())).fields
    if any(x.fields != fields for x in layouts.values()):
        raise ValueError("the layouts must have the same fields")
    names = [*(f.name for f in fields), "reason"]
    clash = {c.lower() for c in keep} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns of the result can't be kept from the input: {sorted(clash)}")
    df = only(df, *keep, raw, layout)
    raw_name = free_name(keep, "raw")
    layout_name = free_name([*keep, raw_name], "layout")
    read = df.select(*[quoted(c) for c in keep], quoted(raw).cast("string").alias(raw_name), quoted(layout).cast("string").alias(layout_name))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keep)]]
    schema = ", ".join([*schema, *(f"`{f.name}` {_SPARK[f.kind]}" for f in fields), "reason string"])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(width + 1)
            left = pc.invert(pc.fill_null(pc.is_in(kinds, pa.array(list(layouts), pa.string())), False))
            for kind, mask in [*((k, pc.fill_null(pc.equal(kinds, k), False)) for k in layouts), (None, left)]:
                part = batch.filter(mask)
                n = part.num_rows
                if not n:
                    continue
                if kind is None:
                    columns, reasons = [pa.nulls(n, _ARROW[f.kind]) for f in fields], pa.array(["unknown layout"] * n)
                else:
                    columns, reasons = parse_block(part.column(width), layouts[kind])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns, reasons], names=[*part.schema.names[:width], *names])

    return spread(read).mapInArrow(run, schema)


def without_headers(df: DataFrame, line_no: str, layout: str, with_header: str = "csv") -> DataFrame:
    """Leave out line 1 of the files of layout ``with_header``, their header; a null line number is no header."""
    return df.where(~F.coalesce((quoted(line_no) == 1) & (quoted(layout) == with_header), F.lit(False)))


def valid_records(parsed: DataFrame) -> DataFrame:
    """The typed rows of ``parse_records``."""
    return parsed.where("reason IS NULL").drop("reason")


def rejected_records(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The records that are none, with the reason."""
    return parsed.where("reason IS NOT NULL").select(*[quoted(c) for c in keep], "reason")
