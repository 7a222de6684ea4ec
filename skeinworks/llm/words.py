"""Cue text as arrays of word hashes, whole batches at a time.

Words are compared by what misreading leaves alone: case, accents and the usual
confusions of character recognition do not count.  Characters are looked up in one
table of code points, so the cost per character is a few array operations.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Characters that recognition confuses, written as what they are built of.
CONFUSED = {
    "0": "o", "1": "i", "5": "s", "8": "b", "l": "i", "q": "g", "e": "c", "f": "t",
    "d": "ci", "h": "ii", "m": "rn", "w": "vv", "|": "i", "ß": "ss", "œ": "oc", "æ": "ac", "ł": "i", "ø": "o", "đ": "ci", "ı": "i",
}
JOINED = "'’‘´`ʼ­️​‍﻿"
#: What stands for the number and the times of a cue: no part of a word.
CUE = "\x1e"
_B = np.uint64(0x9E3779B97F4A7C15)

_timing = re.compile(r"^(?:[^\S\n]*\d+[^\S\n]*\n)?[^\n]*?-->[^\n]*", re.M)
_form = re.compile(r"<[^<>\n]{0,40}>|\{[^{}\n]{0,60}\}|\[[^\[\]]{0,80}\]|\([^()]{0,80}\)|\*[^*\n]{1,40}\*")
_label = re.compile(r"^[^\S\n]*(?:[-–—“\"][^\S\n]*)*([^\W\d_a-z]{2,24})[^\S\n]*:", re.M)


def code_letters(c: str) -> tuple[int, int]:
    """The one or two code letters of a character; 0 separates, 1 is nothing."""
    if c in JOINED or unicodedata.combining(c):
        return 1, 1
    if not c.isalnum() and c not in CONFUSED:
        return 0, 1
    text = "".join(CONFUSED.get(x, x) for s in c.casefold() for x in unicodedata.normalize("NFKD", CONFUSED.get(s, s)) if not unicodedata.combining(x))[:2]
    return (ord(text[0]) + 1, ord(text[1]) + 1 if len(text) > 1 else 1) if text else (0, 1)


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """For every code point of the first plane its code letters."""
    first, second = np.zeros(65_536, np.uint32), np.ones(65_536, np.uint32)
    for cp in range(65_536):
        if not 0xD800 <= cp < 0xE000:
            first[cp], second[cp] = code_letters(chr(cp))
    return first, second


_state: dict = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The look-up tables, made once in each Python process."""
    if "lut" not in _state:
        _state["lut"] = _lookup()
    return _state["lut"]


def without_form(text: str, kept_labels: frozenset[str] = frozenset()) -> str:
    """The words of the cues: no numbers and times of cues, markup, sounds, speaker labels.

    ``CUE`` stands where a cue begins.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.removeprefix("﻿").removeprefix("WEBVTT")
    text = _form.sub(" ", _timing.sub(CUE, text))
    return _label.sub(lambda m: m[0] if m[1].casefold() in kept_labels else " ", text) if ":" in text else text


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, where each text starts (one entry more than texts), and the words that begin a cue.

    Letters of any plane make words.
    """
    first, second = tables()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    far = np.flatnonzero(cp >= 65_536)
    near = np.where(cp < 65_536, cp, 0).astype(np.int64) if len(far) else cp
    pair = np.empty((len(cp), 2), np.uint32)
    pair[:, 0], pair[:, 1] = first[near], second[near]
    if len(far):
        distinct, of = np.unique(cp[far], return_inverse=True)
        pair[far] = np.array([code_letters(chr(c)) for c in distinct], np.uint32)[of]
    codes = pair.reshape(-1)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) * 2  # where each text ends among the codes
    marks = np.flatnonzero(cp == ord(CUE)) * 2
    keep = codes != 1
    kept = codes[keep].astype(np.uint64)
    before = np.concatenate([[0], np.cumsum(keep)])
    text_end, cue_at = before[ends], before[marks]
    inside = kept != 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word's hash is a polynomial in its letters, from prefix sums within blocks of positions.
    power = _powers(len(kept) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept * kept * power[: len(kept)], dtype=np.uint64)])
    h = (total[end] - total[begin]) * _inverse_powers(len(kept) + 1)[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    starts = np.concatenate([[0], np.searchsorted(begin, text_end)])
    return h, starts, np.searchsorted(begin, cue_at)


def _grown(name: str, n: int, base: np.uint64) -> np.ndarray:
    have = _state.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _state[name] = have
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _grown("power", n, _B)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("inverse", n, np.uint64(pow(int(_B), -1, 1 << 64)))
