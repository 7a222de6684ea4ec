"""MD4 (RFC 1320), which neither Spark nor this Python's OpenSSL offers."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


# Fixed values of the standard: what each round mixes, adds, in which order it takes the words, and turns.
_ROUNDS = (
    (lambda x, y, z: x & y | ~x & z, 0, [*range(16)], (3, 7, 11, 19)),
    (lambda x, y, z: x & y | x & z | y & z, 0x5A827999, [0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3, 7, 11, 15], (3, 5, 9, 13)),
    (lambda x, y, z: x ^ y ^ z, 0x6ED9EBA1, [0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15], (3, 9, 11, 15)),
)


def md4_many(data: list[bytes]) -> list[str]:
    """Hex digests, all texts of as many blocks at once."""
    out: list[str] = [""] * len(data)
    blocks: dict[int, list[int]] = {}
    for i, d in enumerate(data):
        blocks.setdefault((len(d) + 72) // 64, []).append(i)
    for n, members in blocks.items():
        raw = b"".join(data[i] + b"\x80" + b"\0" * (64 * n - 9 - len(data[i])) + struct.pack("<Q", len(data[i]) * 8 & (1 << 64) - 1) for i in members)
        words = np.frombuffer(raw, "<u4").reshape(len(members), n, 16).astype(np.uint32)
        state = [np.full(len(members), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for block in range(n):
            a, b, c, d = state
            for mix, add, order, turns in _ROUNDS:
                for step, k in enumerate(order):
                    a, b, c, d = d, _turned(a + mix(b, c, d) + words[:, block, k] + np.uint32(add), turns[step % 4]), b, c
            state = [x + y for x, y in zip(state, (a, b, c, d))]
        digests = np.stack(state, axis=1).astype("<u4").tobytes().hex()
        for place, i in enumerate(members):
            out[i] = digests[32 * place : 32 * place + 32]
    return out


def md4(data: bytes) -> str:
    """Hex digest."""
    return md4_many([data])[0]


def md4_hex(text: Column) -> Column:
    """MD4 of a text's UTF-8, in hex; null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        there = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[there] = md4_many([t.encode() for t in s[there]])
        return out

    return run(text)
