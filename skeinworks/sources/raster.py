"""Grayscale PNG pictures as tables: a row per line, the pixels as an array of 0..1."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_gray(data: bytes) -> np.ndarray:
    """Pixels of a non-interlaced 8- or 16-bit grayscale PNG, scaled to 0..1."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    width, height, depth, color, _, _, interlaced = head
    if color != 0 or depth not in (8, 16) or interlaced:
        raise ValueError("only plain 8- and 16-bit grayscale is read")
    unit = depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * unit)
    out = np.zeros((height, width * unit), np.uint8)
    above = np.zeros(width * unit, np.int64)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if how == 2:
            line = line + above
        elif how == 1:
            line = np.concatenate([np.cumsum(line[k::unit])[:, None] for k in range(unit)], axis=1).reshape(-1)
        elif how in (3, 4):
            for x in range(len(line)):
                a = line[x - unit] if x >= unit else 0
                b, c = above[x], above[x - unit] if x >= unit else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    pixels = out.view(">u2").reshape(height, width) if unit == 2 else out
    return pixels / (65_535.0 if unit == 2 else 255.0)


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``__row``, ``pixels``) of every picture; one picture is decoded in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pixels = decode_gray(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pixels)), pa.array(np.arange(len(pixels))), pa.array(list(pixels), pa.list_(pa.float64()))], names=["path", "__row", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, __row bigint, pixels array<double>")
