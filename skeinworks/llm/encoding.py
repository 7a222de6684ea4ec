"""Text that was written in one encoding and read in another.

Every distinct clean word of the corpus is written and read through all chains of
encodings, which gives a table of garbled forms.  The distinct tokens of the corpus
are hash-joined with it; a token that is the garbled form of a word more common than
itself is garbled, and the word is its original.  Common is what many distinct texts
have, copies counting once; and whatever the counts, a text in which one chain explains
several tokens that no intact text has is read wrongly.

Words that occur nowhere intact have no form in the table.  For the tokens that the join
leaves, and only for them, the characters of the clean words stand in: a token is
garbled if forms of characters (for chains that write UTF-8, whose forms are several
characters long and so unmistakable) make it up, or if it holds a sign no text has.
Column ``path`` says which way a token was found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import only, quoted, stage

# Encodings a text may have been written in, and ones it may be read in.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852")
READ = ("utf-8", "cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp1254")
# Signs that stand beside words in clean text.
OPENING, CLOSING, BETWEEN = "“‘„«‹¿¡—–♪•(", "”’»›…—–♪“‘©®™°", "’‘—–…‐-"
SIGNS = "’‘“”„«»‹›…—–¿¡♪♫©®™°£€§№ ﻿"

LOST = "�"
#: What a distinct text counts beside a row that repeats it: copies are no evidence.
TEXT = 1 << 30
#: Tokens no intact text has that one chain must explain for a text to be taken as read wrongly.
COHERENT = 2
#: Rows, and characters in them, up to which the table of garbled tokens is broadcast instead of shuffled.
BROADCAST_ROWS, BROADCAST_CHARACTERS = 20_000, 4_000_000
#: A run of ASCII letters and digits and of anything beyond ASCII, with at least one of the latter.
#: Possessive and begun only where a run begins, so linear in texts without blanks; read alike by Java and Python.
_BEYOND = "\x80-\U0010ffff"
TOKEN = f"(?<![A-Za-z0-9{_BEYOND}])[A-Za-z0-9]*+[{_BEYOND}][A-Za-z0-9{_BEYOND}]*+"
#: Bits, as a power of two, of the filter for forms that some token has (8 MB).
FILTER_BITS = 26
#: Letters a word must have to vouch for a sign beside it.
LETTERS = 3
_script = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏ]+|[Ͱ-Ͽ]+|[Ѐ-ԯ]+")
_beside = re.compile("[" + re.escape(BETWEEN + OPENING + CLOSING) + "]")
_split = re.compile("[" + re.escape(BETWEEN) + "]")


def _table(name: str) -> dict[int, str]:
    """Byte to character; bytes an encoding leaves undefined stay control characters."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_TABLES = {name: _table(name) for name in READ if name != "utf-8"}


def read_as(raw: bytes, name: str) -> str:
    """Decode as a forgiving reader does."""
    if name == "utf-8":
        return raw.decode("utf-8", "replace")
    return raw.decode("latin-1").translate(_TABLES[name])


def garbled_forms(text: str) -> dict[str, str]:
    """Every form that ``text`` takes under a chain of encodings, with the chain."""
    out: dict[str, str] = {}
    for a in WRITTEN:
        try:
            raw = text.encode(a)
        except UnicodeEncodeError:
            continue
        for b in READ:
            if b == a:
                continue
            form = read_as(raw, b)
            if form != text:
                out.setdefault(form, f"{a}>{b}")
                if LOST in form:  # a reader that gives one sign per byte, or drops them
                    out.setdefault(raw.decode("ascii", "replace"), f"{a}>ascii")
                elif a == "utf-8":
                    try:
                        twice = form.encode("utf-8")
                    except UnicodeEncodeError:
                        continue
                    for c in {b, "cp1252", "latin-1"} - {"utf-8"}:
                        out.setdefault(read_as(twice, c), f"{a}>{b}>utf-8>{c}")
        if a == "utf-8":
            out.setdefault(raw.decode("ascii", "replace"), "utf-8>ascii")
    out.pop(text, None)
    return out


def utf8_forms(character: str) -> Iterator[tuple[str, str]]:
    """The forms, at least two characters long, of a single character written as UTF-8."""
    for form, chain in garbled_forms(character).items():
        if chain.startswith("utf-8>") and len(form) > 1 and LOST not in form:
            yield form, chain


def plain_word(word: str) -> bool:
    """Letters of one script in ordinary case: all small, all capital, or a capital first."""
    if not _script.fullmatch(word) or "ª" in word or "º" in word:
        return False
    return word[1:].islower() or word.isupper() or len(word) == 1 or word[1:].upper() == word[1:] == word[1:].lower()


def clean_pieces(token: str) -> list[str] | None:
    """The words of a token that looks intact, None if it does not."""
    core = token.lstrip(OPENING).rstrip(CLOSING)
    pieces = [p.strip("0123456789") for p in _split.split(core)]
    pieces = [p for p in pieces if p]
    return pieces if all(plain_word(p) for p in pieces) else None


def sign_of(token: str) -> str | None:
    """The sign of a token that is one (a unit, a fraction, a root) among ASCII letters and digits, as °C and √2 are."""
    beyond = [c for c in token if c > "\x7f"]
    sign = len(beyond) == 1 and unicodedata.category(beyond[0]) in ("Sm", "So", "Sc", "No") and not "─" <= beyond[0] <= "▟" and beyond[0] != LOST
    return beyond[0] if sign else None


def impossible(token: str) -> bool:
    """It holds a sign no intact text has: a lost character or a C1 control."""
    return LOST in token or any("\x80" <= c <= "\x9f" for c in token)


def _text_key(t) -> list:
    """What tells texts apart: 96 bits of hashes."""
    return [F.xxhash64(t).alias("h"), F.hash(t).alias("h2")]


#: Bytes of UTF-8 that a token is made of: ASCII letters and digits, and all beyond ASCII.
_IN_TOKEN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """What ``TOKEN`` finds in each text, from the bytes of all texts at once."""
    wide = pa.large_string()
    lines = pc.binary_join_element_wise(pc.fill_null(texts.cast(wide), ""), pa.scalar("", wide), pa.scalar("\n", wide))  # a line end parts the texts
    starts = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
    raw = np.frombuffer(lines.buffers()[2], np.uint8)[starts[0] : starts[-1]] if len(lines) else np.zeros(0, np.uint8)
    starts = starts - starts[0]
    inside = np.concatenate([[False], _IN_TOKEN[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    beyond = np.concatenate([[0], np.cumsum(raw >= 128)])
    found = beyond[end] > beyond[begin]
    begin, end = begin[found], end[found]
    keep = np.zeros(len(raw) + 1, np.int8)
    keep[begin] += 1
    keep[end] -= 1
    letters = raw[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, starts).astype(np.int32)), words)


def text_tokens(df: DataFrame, text: str) -> DataFrame:
    """(``h``, ``h2``, ``tokens``, ``n_rows``): the distinct tokens with a character beyond ASCII of each distinct text, and its rows."""
    t = quoted(text).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tokens_of(b.column(2))], names=["h", "h2", "tokens"])

    read = df.select(*_text_key(t), t.alias("t")).where("t IS NOT NULL")
    found = read.mapInArrow(run, "h bigint, h2 int, tokens array<string>").where("size(tokens) > 0").withColumn("tokens", F.array_distinct("tokens"))
    return found.groupBy("h", "h2").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def token_counts(texts: DataFrame) -> DataFrame:
    """(``token``, ``n_docs``): the tokens and the distinct texts they stand in, times ``TEXT``, plus the rows, which decide between equals."""
    weight = F.count(F.lit(1)) * TEXT + F.sum("n_rows")
    return texts.select(F.explode("tokens").alias("token"), "n_rows").groupBy("token").agg(weight.alias("n_docs"))


def _core(token: str) -> str:
    return token.lstrip(OPENING).rstrip(CLOSING)


def split_tokens(tokens: DataFrame) -> DataFrame:
    """(``word``, ``n``) of the words of the tokens that look intact, and (``token``, ``n``, ``part``, ``looks_clean``) of the parts of all tokens that may be garbled.

    Words of three letters or more come with the signs beside or inside them too
    (quotes, apostrophes, dots), as a garbled sign is found by its word; so do signs with
    letters or digits that are no word, and characters that stand alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for token, n in zip(b["token"], b["n_docs"]):
                pieces = clean_pieces(token)
                if len(token) == 1 and not impossible(token):
                    rows.append((None, n, None, None, token))
                if pieces or sign_of(token):
                    whole = {_core(token), token} if not pieces or sum(map(len, pieces)) >= LETTERS else set()
                    rows += [(None, n, None, None, w) for w in whole.union(pieces or ()) if len(w) > 1 and not w.isascii()]
                parts = {token, _core(token)}
                parts |= set(pieces) if pieces is not None else {token.strip(OPENING + CLOSING), *_beside.split(token)}
                rows += [(token, n, p, clean_pieces(p) is not None, None) for p in parts if len(p) > 1 and not p.isascii()]
            yield pd.DataFrame(rows, columns=["token", "n_docs", "part", "looks_clean", "word"])

    return tokens.mapInPandas(run, "token string, n_docs bigint, part string, looks_clean boolean, word string")


def _places(texts) -> np.ndarray:
    """The bits of a filter for some texts."""
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False) >> np.uint64(64 - FILTER_BITS)


def part_filter(parts: DataFrame) -> np.ndarray:
    """A bit table of the parts, by which most forms that no token has are dropped where they are made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                h = np.unique(_places(b["part"]))
                yield pd.DataFrame({"word": (h >> np.uint64(6)).astype(np.int64), "bit": (h & np.uint64(63)).astype(np.int32)})

    bits = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    words = parts.select("part").mapInPandas(run, "word bigint, bit int").groupBy("word").agg(bits).toPandas()  # at most 2 ** (FILTER_BITS - 6) rows
    mask = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    mask[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return mask


def form_table(words: DataFrame, mask: np.ndarray) -> DataFrame:
    """(``form``, ``original``, ``chain``, ``n``, ``bare``): garbled forms of the words, those the filter lets through; ``bare`` has no sign beside it."""
    sent = words.sparkSession.sparkContext.broadcast(mask)  # 2 ** FILTER_BITS bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                rows = [(form, w, chain, n, plain_word(w)) for w, n in zip(b["word"][at : at + 500], b["n"][at : at + 500]) for form, chain in (garbled_forms(w).items() if len(w) > 1 else utf8_forms(w)) if form.casefold() != w.casefold()]
                if rows:
                    h = _places([r[0] for r in rows])
                    met = sent.value[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1) == 1
                    rows = [rows[i] for i in np.flatnonzero(met)]
                yield pd.DataFrame(rows, columns=["form", "original", "chain", "n", "bare"])

    tasks = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return words.repartition(tasks).mapInPandas(run, "form string, original string, chain string, n bigint, bare boolean")


def character_forms(words: DataFrame, tokens: DataFrame) -> tuple[dict[str, str], set[str]]:
    """Multi-character forms of single characters, and these characters.

    They are the distinct characters of the words (which have the signs beside them), the
    signs of ``SIGNS``, and those that stand as a token of their own; where two share a form, the more common has it.  There are at
    most as many characters as Unicode has, so the driver may hold them.
    """
    each = words.select(F.explode(F.split("word", "")).alias("c"), "n").unionByName(tokens.where("length(token) = 1").selectExpr("token AS c", "n_docs AS n"))
    found = each.where("c > '\x7f'").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect()
    out: dict[str, str] = {}
    known = dict.fromkeys([*(r[0] for r in found if not impossible(r[0])), *SIGNS])
    for c in known:
        for form, _ in utf8_forms(c):
            out.setdefault(form, c)
    return out, set(known)


def undo_characters(token: str, forms: dict[str, str], longest: int) -> tuple[str, int]:
    """Replace the forms of characters in a token, the longest first; how many there were."""
    out, at, hits = [], 0, 0
    while at < len(token):
        if token[at] > "\x7f":
            for n in range(min(longest, len(token) - at), 1, -1):
                c = forms.get(token[at : at + n])
                if c is not None:
                    out.append(c)
                    at += n
                    hits += 1
                    break
            else:
                out.append(token[at])
                at += 1
        else:
            out.append(token[at])
            at += 1
    return "".join(out), hits


def _small(df: DataFrame, column: str) -> DataFrame:
    """``df``, marked for broadcast if it is known to be small."""
    rows, characters = df.agg(F.count(F.lit(1)), F.sum(F.length(column))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (characters or 0) <= BROADCAST_CHARACTERS else df


def coherent_forms(texts: DataFrame, parts: DataFrame, forms: DataFrame) -> DataFrame:
    """(``part``, ``chain``, ``looks_clean``): forms that other tokens of their texts confirm, however common they are.

    A text in which one chain explains ``COHERENT`` tokens that no intact text has is
    read wrongly.  In it the chain's other forms are garbled too, those that look like
    intact words if they stand in such texts for the most part.
    """
    places = stage(forms.where(~F.contains("part", F.lit(LOST))).select("part", "chain", "own").distinct().join(parts.select("token", "part", "looks_clean"), "part"))
    odd = places.where("NOT looks_clean").select("token", "part", "chain")
    told = texts.select("h", "h2", F.explode("tokens").alias("token")).join(_small(odd, "token"), "token")
    wrong = stage(told.groupBy("h", "h2", "chain").agg(F.countDistinct("part").alias("n")).where(F.col("n") >= COHERENT).select("h", "h2", "chain"))
    # Only the texts read wrongly, few as a rule, are searched for their chain's other forms.
    those = texts.join(wrong, ["h", "h2"]).select("h", "h2", "chain", F.explode("tokens").alias("token"))
    within = those.join(places, ["token", "chain"]).groupBy("part", "chain", "looks_clean").agg(F.countDistinct("h", "h2").alias("n_texts"), F.max("own").alias("own"))
    return within.where(f"NOT looks_clean OR own < n_texts * {2 * TEXT}").select("part", "chain", "looks_clean")


def garbled_tokens(texts: DataFrame) -> DataFrame:
    """(``token``, ``original``, ``chain``, ``path``): the garbled tokens of ``text_tokens``; ``original`` is null if unknown.

    ``path``: ``word`` (by the table of forms), ``characters``, ``word and characters``
    or ``lost`` (a sign no intact text has, and nothing that explains it).
    """
    tokens = stage(token_counts(texts))
    split = stage(split_tokens(tokens))
    words = split.where("word IS NOT NULL").groupBy("word").agg(F.sum("n_docs").alias("n"))
    parts = split.where("part IS NOT NULL").select("token", "n_docs", "part", "looks_clean")
    with ThreadPool(1) as beside:  # the few characters come to the driver while the forms are made
        single = beside.apply_async(inheritable_thread_target(tokens.sparkSession)(character_forms), (words, tokens))
        forms = stage(
            parts.groupBy("part")
            .agg(F.sum("n_docs").alias("own"))
            .join(form_table(words, part_filter(parts)).withColumnRenamed("form", "part").hint("shuffle_hash"), "part")  # its size grows with the corpus: never broadcast
        )
        characters, known = single.get()
    longest = max(map(len, characters))
    confirmed = stage(coherent_forms(texts, parts, forms))
    # A word that is itself such a form is nobody's original: else the sense turns round where garbled texts are many.
    garbled_words = confirmed.where("looks_clean").select(F.col("part").alias("original")).distinct()
    changed = (
        forms.join(confirmed.select("part", "chain", F.lit(True).alias("coherent")), ["part", "chain"], "left")
        .where("n > own OR coherent")
        .join(garbled_words, "original", "left_anti")
        .groupBy("part")
        .agg(F.max_by(F.struct("original", "chain"), F.struct(F.contains("part", F.lit(LOST)) & F.col("bare"), F.col("n"), F.col("original"))).alias("best"), F.countDistinct("original").alias("all_ways"), F.countDistinct(F.when(F.col("bare"), F.col("original"))).alias("bare_ways"))
        .withColumn("ways", F.when(F.col("bare_ways") > 0, F.col("bare_ways")).otherwise(F.col("all_ways")))
    )
    certain = (F.col("ways") == 1) | ~F.contains("part", F.lit(LOST))  # of several words that lost the same letters none is certain
    joined = parts.join(changed.hint("shuffle_hash"), "part").select("token", F.when(certain, F.replace("token", "part", "best.original")).alias("original"), "best.chain", F.length("part").alias("size"))
    order = F.struct(F.col("original").isNotNull(), F.col("size"), F.col("original"))
    by_word = joined.groupBy("token").agg(F.max_by(F.struct("original", "chain"), order).alias("b")).select("token", "b.original", "b.chain", F.lit(True).alias("met"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for token, original, chain, met in zip(b["token"], b["original"], b["chain"], b["met"].notna()):
                if met and (original is None or clean_pieces(original) is not None):
                    rows.append((token, original, chain, "word"))
                    continue
                undone, hits = undo_characters(original if met else token, characters, longest) if met or clean_pieces(token) is None else (token, 0)
                if hits and all(c in known for c in undone if c > "\x7f") and (not met or clean_pieces(undone) is not None):
                    rows.append((token, undone, f"{chain}, utf-8 characters" if met else "utf-8 characters", "word and characters" if met else "characters"))
                elif met:
                    rows.append((token, original, chain, "word"))
                elif impossible(token):
                    rows.append((token, None, "lost", "lost"))
            yield pd.DataFrame(rows, columns=["token", "original", "chain", "path"])

    return tokens.select("token").join(by_word, "token", "left").mapInPandas(rest, "token string, original string, chain string, path string")


def _by_text(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The garbled tokens of every text that has some."""
    return texts.select("h", "h2", F.explode("tokens").alias("token")).join(_small(found, "token"), "token")


def affected(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row per affected record: id, ``n_garbled`` and ``n_restorable`` distinct tokens, ``chains``, ``paths``.

    A null or empty text is not affected.  Repeated rows are judged alike; of a repeated
    id every affected text has a row, equal ones one.  Long texts are read whole.  An
    empty table gives an empty result.  Other columns are not read.
    """
    df = only(df, id_column, text)
    texts = stage(text_tokens(df, text))
    found = stage(garbled_tokens(texts))
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("chain", "path")]
    wrong = _by_text(texts, found).groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n_garbled"), F.count("original").alias("n_restorable"), *sets)
    rows = df.select(quoted(id_column).alias("__id"), *_text_key(quoted(text).cast("string"))).distinct()
    return rows.join(wrong, ["h", "h2"]).drop("h", "h2").withColumnRenamed("__id", id_column)


def restored(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The affected records: id, ``restored_text``, and ``complete`` (no garbled token is left).

    Garbled tokens with a known original are replaced, the others stay as they are.
    The pairs of one record are no more than its distinct tokens.
    """
    df = only(df, id_column, text)
    texts = stage(text_tokens(df, text))
    found = stage(garbled_tokens(texts))
    pairs = _by_text(texts, found).groupBy("h", "h2").agg(F.collect_list(F.struct("token", "original")).alias("pairs"))
    token = re.compile(TOKEN)

    @F.pandas_udf("string")
    def mend(texts: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, pairs):
            known = {x["token"]: x["original"] for x in p if x["original"] is not None}
            out.append(token.sub(lambda m: known.get(m[0], m[0]), t))  # noqa: B023
        return pd.Series(out)

    t = quoted(text).cast("string")
    rows = df.select(quoted(id_column).alias("__id"), t.alias("__text"), *_text_key(t))
    return rows.join(pairs, ["h", "h2"]).select(F.col("__id").alias(id_column), mend("__text", "pairs").alias("restored_text"), F.forall("pairs", lambda x: x["original"].isNotNull()).alias("complete"))
