"""What Parquet files say about their column chunks without being scanned.

Footers give row counts, nulls and extrema of each chunk; the dictionary page, where
the whole chunk is dictionary-encoded, gives its distinct values.  Only these are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import NativeFile
from pyarrow.fs import FileSystem

_PLAIN, _RLE_DICTIONARY, _PLAIN_DICTIONARY = 0, 8, 2
_DATA_PAGE, _DICTIONARY_PAGE, _DATA_PAGE_V2 = 0, 2, 3


class _Compact:
    """The little of Thrift's compact protocol that page headers need."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at = data, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def number(self) -> int:
        v = self.varint()
        return (v >> 1) ^ -(v & 1)

    def struct(self) -> dict[int, object]:
        out, field = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if head == 0:
                return out
            kind, delta = head & 15, head >> 4
            field = field + delta if delta else self.number()
            out[field] = self.value(kind)

    def value(self, kind: int) -> object:
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (4, 5, 6):
            return self.number()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            return bytes(self.data[self.at - n : self.at])
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 != 15 else self.varint()
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"unexpected Thrift type {kind}")


def _header(f: NativeFile, at: int) -> tuple[dict[int, object], int]:
    """The page header at a place of the file and its length; no more is read than it takes."""
    size = 256
    while True:
        raw = memoryview(f.read_at(size, at))
        try:
            reader = _Compact(raw, 0)
            return reader.struct(), reader.at
        except IndexError:
            if len(raw) < size:
                raise
            size *= 8


def all_in_dictionary(f: NativeFile, start: int, end: int) -> bool:
    """Do all data pages of a chunk use its dictionary?  Asked of their headers, where the footer does not say."""
    at = start
    while at < end:
        head, length = _header(f, at)
        if head[1] in (_DATA_PAGE, _DATA_PAGE_V2):
            page = head[5] if head[1] == _DATA_PAGE else head[8]
            if page[2 if head[1] == _DATA_PAGE else 4] not in (_RLE_DICTIONARY, _PLAIN_DICTIONARY):
                return False
        at += length + head[3]
    return True


def dictionary_at(f: NativeFile, at: int, physical: str, codec: str) -> list | np.ndarray | None:
    """The values of the dictionary page at a place of the file."""
    head, length = _header(f, at)
    if head[1] != _DICTIONARY_PAGE:
        return None
    packed = f.read_at(head[3], at + length)
    plain = packed if codec == "UNCOMPRESSED" else pa.Codec(codec.lower()).decompress(packed, head[2]).to_pybytes()
    return _plain_values(plain, head[7][1], physical)


def page_encodings(f: NativeFile) -> list[list[bool | None]]:
    """For each row group and column what the footer says: data pages all by dictionary, not all, or nothing said."""
    end = f.size()
    size = int.from_bytes(f.read_at(4, end - 8), "little")
    footer = _Compact(memoryview(f.read_at(size, end - 8 - size)), 0).struct()
    out = []
    for group in footer.get(4, []):
        said = []
        for column in group[1]:
            pages = [p for p in column.get(3, {}).get(13, []) if p[1] in (_DATA_PAGE, _DATA_PAGE_V2)]
            said.append(all(p[2] in (_RLE_DICTIONARY, _PLAIN_DICTIONARY) for p in pages) if pages else None)
        out.append(said)
    return out


def _plain_values(data: bytes, n: int, physical: str):
    kinds = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}
    if physical in kinds:
        return np.frombuffer(data, kinds[physical], n)
    if physical != "BYTE_ARRAY":
        return None
    out, at = [], 0
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


@dataclass(frozen=True)
class Chunk:
    """One column of one row group."""

    group: int
    n_rows: int
    column: str
    part: int | None  # the value of the part column, if it is the same in the whole row group
    nulls: int | None
    lowest: object
    highest: object
    dictionary: object  # distinct values, if known
    size: int  # bytes in the file


def columns_of(uri: str) -> set[str]:
    """The plain columns of a file."""
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        schema = pq.ParquetFile(f).metadata.schema
        return {schema.column(j).path for j in range(len(schema))}


def chunks_of(uri: str, part: str, columns: list[str], with_dictionary: list[str]) -> list[Chunk]:
    """Every wanted chunk of a file; ``part`` is an integer column that splits the table.

    Read are the footer, and of the columns ``with_dictionary`` the dictionary pages of
    the chunks that have one part only; data pages are not.
    """
    fs, path = FileSystem.from_uri(uri)
    out, encodings = [], None
    with fs.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        names = {meta.schema.column(j).path: j for j in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            s = group.column(names[part]).statistics
            same = s.min if s and s.has_min_max and s.min == s.max and s.has_null_count and s.null_count == 0 else None
            for c in columns:
                col = group.column(names[c])
                st = col.statistics
                exact = st is not None and st.has_min_max
                known = None
                if same is not None and c in with_dictionary and col.has_dictionary_page:
                    if encodings is None:
                        encodings = page_encodings(f)
                    start = min(x for x in (col.dictionary_page_offset, col.data_page_offset) if x)
                    said = encodings[g][names[c]]
                    if said if said is not None else all_in_dictionary(f, start, start + col.total_compressed_size):
                        known = dictionary_at(f, start, col.physical_type, col.compression)
                out.append(Chunk(g, group.num_rows, c, same, st.null_count if st is not None and st.has_null_count else None, st.min if exact else None, st.max if exact else None, known, col.total_compressed_size))
    return out
