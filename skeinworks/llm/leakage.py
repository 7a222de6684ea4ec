"""Passages of held-out items inside a corpus.

Every stretch of a window's words, of the items and of the corpus, is embedded by a
random walk (Chakraborty, Goldenberg, Koucky: each step emits the current word and
moves on or not, by a random bit of step and word), which turns few edits into few
differing places.  Samples of these places are the keys of a locality-sensitive hash,
repeated over as many walks as a target recall needs.  Windows that share a key with
an item are candidates; an exact alignment of the words decides, in a band as wide as
the item's own tolerance.

A window is as large as half of its item, the least a leak may have, up to the largest
of ``WINDOWS``: in a longer leak the errors leave a stretch of that size nearly intact.

The corpus is read once per block of items and never shuffled: a task streams its
documents, and only hits leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm import encoding, words
from skeinworks.session import only, quoted, spread

#: Words of a window; an item has the largest that its half holds.
WINDOWS = (1, 2, 3, 4, 6, 8, 12)
#: Samples of each random walk, places in a sample, and how many walks are tried for the target recall.
SAMPLES, PLACES, MOST_WALKS = 8, 7, 16
#: Share of an item a leak must have, and of its words that may disagree.
SHARE, TOLERANCE = 0.5, 0.1
#: Words next to each other that a part of a passage must have for a whole cue to stand between it and the next.
SEED = 6
#: Whole cues, one behind the other, that may part a passage.
BETWEEN = 2
#: Characters of corpus text that are worked on at once; a longer text is worked on whole.
CHUNK = 600_000
#: Items and their characters whose keys a task holds at once; more are searched in further passes.
ITEM_BLOCK, ITEM_CHARACTERS = 20_000, 8_000_000
#: Cells of the tables in which candidates are compared at once.
COMPARED = 4_000_000
#: A text without any of this needs no mending: signs and letters beyond those of clean text.
SUSPECT = r"[\x80-\x9f\xa2-\xa6\xa8\xaa\xac\xad\xaf\xb2-\xb6\xb8-\xba\xbc-\xbe\xc2\xc3\xd0\xd7\xde\xf0\xf7\xfe\u0102\u0139\u0192\u02c6-\u036f\u0370-\u03ff\u0400-\u04ff\u201a\u201b\u201e\u2020-\u2025\u2027-\u2115\u2117-\u2122\u2190-\u25ff\ufffd]|[a-z][\xc0-\xde]|[\xc0-\xff]{4}|[^\x00-\x7f\xa1\xab\xbb\xbf-\xff\u0100-\u017f\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u266a\ufeff]"


class _Plan:
    """Walk bits and sampled places for windows of ``size`` words, the same everywhere."""

    def __init__(self, size: int, walks: int, seed: int = 7):
        self.size = size
        rng = np.random.default_rng([seed, size])
        if size < SEED:  # leaks of items this short must be intact: the window is its own key
            self.steps, self.multipliers = size, np.zeros(1, np.uint64)
            self.samples, self.factors = [[np.arange(size)]], rng.integers(1, 1 << 62, (1, 1, size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            return
        self.steps = 2 * size
        places = min(PLACES, size)
        self.multipliers, self.samples, self.factors = np.zeros(walks, np.uint64), [], np.zeros((walks, SAMPLES, places), np.uint64)
        for w in range(walks):
            self.multipliers[w] = rng.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.samples.append([np.sort(rng.choice(self.steps, places, replace=False)) for _ in range(SAMPLES)])
            self.factors[w] = rng.integers(1, 1 << 62, (SAMPLES, places), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @property
    def tables(self) -> int:
        return sum(map(len, self.samples))


def window_keys(h: np.ndarray, plan: _Plan) -> Iterator[np.ndarray]:
    """For each table, the key of the window at every word; past the window's end is nothing."""
    n, size = len(h), plan.size
    padded = np.concatenate([h, np.zeros(plan.steps, np.uint64)])
    begin = np.arange(n, dtype=np.int64)
    for m, samples, factors in zip(plan.multipliers, plan.samples, plan.factors):
        turn = padded * m
        turn ^= turn >> np.uint64(31)
        at = begin.copy()
        keys = [np.zeros(n, np.uint64) for _ in samples]
        last = max(s[-1] for s in samples)
        exact = plan.steps == size
        for step in range(last + 1):
            used = [(i, j) for i, s in enumerate(samples) for j, place in enumerate(s) if place == step]
            if used:
                word = padded[at]
                if step >= size:
                    word[at - begin >= size] = 0
                for i, j in used:
                    keys[i] += word * factors[i, j]
            if step < last:
                at += 1 if exact else ((turn[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        for k in keys:
            k ^= k >> np.uint64(33)
            yield k


def simulated_recall(plan: _Plan, need: int, trials: int = 300, seed: int = 3) -> float:
    """How often a leak of ``need`` words, half of its item, with as many errors as may be shares a key with it (random words)."""
    rng = np.random.default_rng(seed)
    length, wrong = 2 * need, int(need * TOLERANCE + 1e-9)
    items, docs = [], []
    for _ in range(trials):
        item = rng.integers(1, 1 << 62, length, dtype=np.uint64)
        at = int(rng.integers(length - need + 1))
        leak = list(item[at : at + need])
        for _ in range(wrong):
            i, other = int(rng.integers(len(leak))), rng.integers(1, 1 << 62, dtype=np.uint64)
            leak[i : i + 1] = ([other], [], [leak[i], other])[int(rng.integers(3))]
        gap = rng.integers(1, 1 << 62, plan.size, dtype=np.uint64)
        items.append(item)
        docs.append(np.concatenate([gap, np.array(leak, np.uint64), gap]))
    own, other = (window_keys(np.concatenate(x), plan) for x in (items, docs))
    edges = np.cumsum([0, *map(len, docs)])
    met = np.zeros(trials, bool)
    for a, b in zip(own, other):
        for t in np.flatnonzero(~met):
            mine = a[t * length : t * length + length - plan.size + 1]
            met[t] = np.isin(b[edges[t] : edges[t + 1]], mine).any()
    return float(met.mean())


def hardest(size: int) -> list[int]:
    """Lengths of a leak at which one error more is allowed, among those searched with windows of this size."""
    after = min((w for w in WINDOWS if w > size), default=41)
    return [n for n in (size, *range(10, after, 10)) if size <= n < after]


def walks_for(size: int, recall: float) -> int:
    """As many walks as the target recall needs at the hardest leaks."""
    for walks in range(1, MOST_WALKS + 1):
        plan = _Plan(size, walks)
        if plan.tables == 1 or all(simulated_recall(plan, need) >= recall for need in hardest(size)):
            return walks
    raise ValueError(f"no {MOST_WALKS} walks reach a recall of {recall}")


def window_of(n: int) -> int:
    """The window of an item of n words: the largest that half of it holds."""
    return max(w for w in WINDOWS if w <= -(-n // 2))


def _equal_runs(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(item place, text place, length) of the longest stretches of equal words, by place."""
    i, j = np.nonzero(item[:, None] == doc[None, :])
    if not len(i):
        return []
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])
    size = np.diff(np.r_[start, len(i)])
    return sorted(zip(i[start].tolist(), j[start].tolist(), size.tolist()))


def agree(item: np.ndarray, doc: np.ndarray, tolerance: float = TOLERANCE, share: float = SHARE, cues: np.ndarray | None = None) -> bool:
    """Exact check: do the word sequences share a stretch long and alike enough?

    True when some stretch of at least ``share`` of the item's words stands in ``doc``
    with at most ``tolerance`` of them (never rounded up) missing, changed or parted by
    further words.  With ``cues`` (the places in ``doc`` where a cue begins) up to
    ``BETWEEN`` whole cues may once stand between two parts of the stretch; they are no
    error.
    """
    n = len(item)
    need, most = -(-n * share // 1), int(n * tolerance)
    runs = _equal_runs(item, doc)
    longest = max((r[2] for r in runs), default=0)
    borders = None if cues is None else np.unique(np.r_[cues, len(doc)])
    # best[r]: for the errors so far and whether cues were passed over, the earliest item word a chain ending in run r began with
    best: list[dict[tuple[int, int], int]] = []
    for r, (i, j, size) in enumerate(runs):
        mine = {(0, 0): i}
        for p in range(r - 1, -1, -1):
            pi, pj, psize = runs[p]
            if pi < i - most - longest:
                break
            gap_i, gap_j = i - (pi + psize), j - (pj + psize)
            over = max(0, -gap_i, -gap_j)  # overlapping runs: the later gives words up
            if over >= size or pi >= i:
                continue
            cost = max(gap_i + over, gap_j + over)
            ways = [(cost, 0)] if 0 < cost <= most else []
            if borders is not None and gap_j > 0 and over == 0 and gap_i <= most:
                a, z = np.searchsorted(borders, pj + psize, "left"), np.searchsorted(borders, j, "right") - 1
                if z > a:
                    passed = max(int(borders[min(b + BETWEEN, z)] - borders[b]) for b in range(a, z))
                    cost = max(gap_i, gap_j - passed)
                    if cost <= most:
                        ways.append((cost, 1))
            for cost, passing in ways:
                for (errors, passed), start in best[p].items():
                    e, c = errors + cost, passed + passing
                    if e <= most and c <= 1 and start < mine.get((e, c), n):
                        mine[e, c] = start
        best.append(mine)
        for (errors, _), start in mine.items():
            span = i + size - start
            short = max(0, need - span)  # words beyond either end that disagree
            if (errors + short) <= tolerance * (span + short) + 1e-9:
                return True
    return False


class _Keys:
    """The keys of the windows of some items, by table, with a bit table before the exact look-up."""

    def __init__(self, items: _Items, of: list[int], plan: _Plan):
        self.plan, self.keys, self.item, self.place, self.bits = plan, [], [], [], []
        per = [[] for _ in range(plan.tables)]
        item, place = [], []
        for i in of:
            w = items.words(i)
            last = max(0, len(w) - plan.size + 1)
            for t, k in enumerate(window_keys(w, plan)):
                per[t].append(k[:last])
            item.append(np.full(last, i, np.int32))
            place.append(np.arange(last, dtype=np.int32))
        item, place = np.concatenate(item), np.concatenate(place)
        self.n_bits = int(np.clip(np.ceil(np.log2(max(1, len(item)))) + 3, 16, 22))
        for parts in per:
            k = np.concatenate(parts)
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.item.append(item[order])
            self.place.append(place[order])
            bits = np.zeros(1 << self.n_bits, bool)
            bits[(k & np.uint64((1 << self.n_bits) - 1)).astype(np.int64)] = True
            self.bits.append(bits)

    def candidates(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """(item, place in the corpus of the item's first word, place of the window) of shared keys."""
        low = np.uint64((1 << self.n_bits) - 1)
        for t, keys in enumerate(window_keys(h, self.plan)):
            at = np.flatnonzero(self.bits[t][(keys & low).astype(np.int64)])
            own = self.keys[t]
            a, b = np.searchsorted(own, keys[at], "left"), np.searchsorted(own, keys[at], "right")
            count = b - a
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            rep = np.repeat(hit, count[hit])
            offset = np.arange(len(rep)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            where = a[rep] + offset
            yield np.stack([self.item[t][where].astype(np.int64), at[rep] - self.place[t][where], at[rep]])


class _Items:
    """A block of items: their words, and the keys of their windows by size, with so many walks for each size."""

    def __init__(self, texts: list[str], walks: dict[int, int]):
        self.labels = frozenset(w.casefold() for t in texts for w in re.findall(r"([^\W\d_]+)\s*:", t))
        self.flat, self.starts, _ = words.word_hashes(texts)
        self.sizes = np.diff(self.starts)
        by: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            if n:
                by.setdefault(window_of(n), []).append(i)
        self.keys = [_Keys(self, of, _Plan(size, walks[size])) for size, of in sorted(by.items())]
        seeded = [i for i, n in enumerate(self.sizes.tolist()) if -(-n // 2) >= 2 * SEED - 1]
        #: Windows of parts between which cues may stand: intact, as they are short.
        self.seeds = _Keys(self, seeded, _exact(SEED)) if seeded else None
        self.repair = self._garbled(texts)
        self.memo: dict[str, str] = {}

    def words(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    @staticmethod
    def _garbled(texts: list[str]) -> dict[str, str]:
        """Garbled forms of the items' words and characters, for every case they may stand in."""
        vocabulary = {w for t in texts for w in re.findall(r"[^\W_]+(?:[’'][^\W_]+)*", t)}
        vocabulary |= {p for w in vocabulary for p in re.split("[’']", w)}
        vocabulary = {v for w in vocabulary for v in (w, w.lower(), w.upper(), w.capitalize(), w.replace("'", "’"))}
        out: dict[str, str] = {}
        for w in sorted(vocabulary):
            if not w.isascii():
                for form in encoding.garbled_forms(w):
                    if form not in vocabulary:
                        out.setdefault(form, w)
        for c in sorted({c for w in vocabulary for c in w if c > "\x7f"} | set(encoding.SIGNS)):
            for form, _ in encoding.utf8_forms(c):
                out.setdefault(form, c)
        return out

    def _mended(self, t: str) -> str:
        repair = self.repair
        whole = repair.get(t)
        if whole is not None:
            return whole
        if encoding.clean_pieces(t) is not None:
            core = t.lstrip(encoding.OPENING).rstrip(encoding.CLOSING)
            return t.replace(core, repair[core]) if core in repair else t
        undone, hits = encoding.undo_characters(t, repair, 12)
        if hits:
            return undone
        for a in (0, 1, 2):  # a garbled sign before or after the word
            for b in (0, 1, 2):
                core = t[a : len(t) - b]
                if core in repair:
                    return f" {repair[core]} "
        return t

    def mend(self, text: str, token: re.Pattern) -> str:
        """Undo wrong encodings as far as the items' words need it."""
        memo, mended = self.memo, self._mended

        def one(m: re.Match) -> str:
            t = m[0]
            out = memo.get(t)
            if out is None:
                if len(memo) > 200_000:
                    memo.clear()
                out = memo[t] = mended(t)
            return out

        return token.sub(one, text)


def _exact(size: int) -> _Plan:
    """A plan whose single key is the window itself."""
    plan = _Plan.__new__(_Plan)
    rng = np.random.default_rng([11, size])
    plan.size = plan.steps = size
    plan.multipliers, plan.samples = np.zeros(1, np.uint64), [[np.arange(size)]]
    plan.factors = rng.integers(1, 1 << 62, (1, 1, size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return plan


def _unique(found: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Distinct (text, item, offset) of candidates, by text and item."""
    if not found:
        return np.zeros((3, 0), np.int64)
    item, offset, at = np.concatenate(found, axis=1)
    text = np.searchsorted(starts, at, "right") - 1
    return np.unique(np.stack([text, item, offset]), axis=1)


def _search(h: np.ndarray, starts: np.ndarray, cues: np.ndarray, items: _Items) -> set[tuple[int, int]]:
    """(text, item) pairs of a chunk."""
    out: set[tuple[int, int]] = set()
    found = [c for keys in items.keys for c in keys.candidates(h)]
    plain = _unique(found, starts)
    for pair, a, b in _promising(plain, h, starts, items):
        if pair not in out and agree(items.words(pair[1]), h[a:b]):
            out.add(pair)
    if items.seeds is not None and len(cues):
        parted = _unique([*items.seeds.candidates(h)], starts)
        for pair, a, b in _parted(parted, out, h, starts, cues, items):
            inside = cues[np.searchsorted(cues, a) : np.searchsorted(cues, b)] - a
            if pair not in out and agree(items.words(pair[1]), h[a:b], cues=inside):
                out.add(pair)
    return out


def _slices(rows: np.ndarray) -> Iterator[slice]:
    """Stretches of candidates that together compare no more than ``COMPARED`` cells (one at least)."""
    at, total = 0, np.cumsum(rows)
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, "right")))
        yield slice(at, end)
        at = end


def _promising(candidates: np.ndarray, h: np.ndarray, starts: np.ndarray, items: _Items) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Pairs, with the stretch of text to align, in which enough of the item's words stand near their place.

    A leak may be as far off the candidate's diagonal as the item's tolerance has words.
    """
    size = items.sizes[candidates[1]]
    by_size = np.argsort(size, kind="stable")  # so that a stretch has items of nearly one size
    text, item, offset, size = candidates[0][by_size], candidates[1][by_size], candidates[2][by_size], size[by_size]
    slack = (size * TOLERANCE).astype(np.int64) + 2
    enough = np.floor((1 - TOLERANCE) * size * SHARE) - 1
    for part in _slices(size):
        longest = int(size[part].max())
        span = np.arange(longest)
        real = span[None, :] < size[part][:, None]
        w = items.flat[np.where(real, items.starts[item[part]][:, None] + span[None, :], 0)]
        same = np.zeros(w.shape, bool)
        widest = int(slack[part].max())
        low, high = starts[text[part]][:, None], starts[text[part] + 1][:, None]
        for d in range(-widest, widest + 1):
            place = offset[part][:, None] + span[None, :] + d
            ok = (place >= low) & (place < high) & (np.abs(d) <= slack[part])[:, None]
            same |= ok & (h[np.clip(place, 0, len(h) - 1)] == w)
        for k in np.flatnonzero((same & real).sum(axis=1) >= enough[part]) + part.start:
            a, b = max(starts[text[k]], offset[k] - slack[k]), min(starts[text[k] + 1], offset[k] + size[k] + slack[k])
            if a < b:
                yield (int(text[k]), int(item[k])), int(a), int(b)


def _parted(candidates: np.ndarray, known: set, h: np.ndarray, starts: np.ndarray, cues: np.ndarray, items: _Items) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Pairs not yet found, with the stretch of text in which whole cues may stand between two parts of the item."""
    for text, item, offset in candidates.T.tolist():
        if (text, item) in known:
            continue
        n = int(items.sizes[item])
        slack = int(n * TOLERANCE) + 2
        # As many words more on either side as the cues have that may stand between.
        c = np.searchsorted(cues, offset, "right")
        a = max(starts[text], min(offset, cues[max(0, c - 1 - BETWEEN)]) - slack)
        e = np.searchsorted(cues, offset + n, "left")
        b = min(starts[text + 1], max(offset + n, cues[min(len(cues) - 1, e + BETWEEN)] if e + BETWEEN < len(cues) else len(h)) + slack)
        if a < b and np.isin(items.words(item), h[a:b]).sum() >= np.floor((1 - TOLERANCE) * n * SHARE) - 1:
            yield (text, item), int(a), int(b)


def leaks(corpus: DataFrame, id_column: str, text: str, items: DataFrame, item_id: str, item_text: str, *, recall: float = 0.995) -> DataFrame:
    """(``id_column``, ``item_id``): records of the corpus and the items they leak.

    A leak is a stretch of at least half of an item's words, in order and next to each
    other, of which nine in ten agree.  Words are those of the cues (see ``words``);
    case, punctuation, accents, misread characters and wrong encodings do not count.
    One or two whole cues (a song line, a credit, an advert) may once part the passage
    of an item of 21 words or more, if one of its parts has ``SEED`` words intact.

    ``recall``: the share of leaks, of the shortest kind with the most errors, that the
    search must bring to the exact check in simulation; it sets the number of walks.

    * Null or empty texts and items leak nothing.  Items may be of any length; for those
      of less than 20 words half of them is too short to have an error.
    * A repeated record or item gives the same pairs; the result has each pair once
      per row of the corpus with that id, and is made distinct.
    * Long texts are searched whole.  Empty tables give an empty result.  Other columns
      are not read, whatever they are called; ids may be of any type that can be ordered.
    * Items come to the tasks in blocks (``ITEM_BLOCK``, ``ITEM_CHARACTERS``), one pass
      over the corpus each.
    """
    corpus, items = only(corpus, id_column, text), only(items, item_id, item_text)
    read = corpus.select(quoted(id_column).alias("d"), quoted(text).cast("string").alias("t")).where("t IS NOT NULL")
    wanted = items.select(quoted(item_id).alias("i"), quoted(item_text).cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL").distinct()
    kind = wanted.schema["i"].dataType
    parts, after = [], None
    while True:
        left = wanted if after is None else wanted.where(F.struct("i", F.xxhash64("t"), "t") > F.struct(F.lit(after[0]).cast(kind), F.xxhash64(F.lit(after[1])), F.lit(after[1])))
        ordered = left.orderBy("i", F.xxhash64("t"), "t")
        sizes = np.cumsum([r[0] for r in ordered.limit(ITEM_BLOCK).select(F.length("t")).collect()])
        take = max(1, int(np.searchsorted(sizes, ITEM_CHARACTERS, "right")))
        rows = ordered.limit(take).collect() if len(sizes) else []
        if rows or not parts:
            parts.append(_pass(read, [r[0] for r in rows], [r[1] for r in rows], kind, recall))
        if not rows or (take >= len(sizes) and len(sizes) < ITEM_BLOCK):
            break
        after = tuple(rows[-1])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().select(F.col("d").alias(id_column), F.col("i").alias(item_id))


def _pass(read: DataFrame, ids: list, texts: list[str], kind, recall: float) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    sizes = {window_of(n) for n in np.diff(words.word_hashes(texts)[1]).tolist() if n} if texts else set()
    walks = {size: walks_for(size, recall) for size in sizes}
    # At most ITEM_BLOCK items, ITEM_CHARACTERS and one item of text.  A Python worker keeps what it is sent, so it makes the keys once.
    sent = read.sparkSession.sparkContext.broadcast({"names": pa.array(ids, to_arrow_type(kind)), "texts": texts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = sent.value["names"], sent.value["texts"]
        items = sent.value.get("items") or sent.value.setdefault("items", _Items(wanted, walks))
        token = re.compile(encoding.TOKEN)
        odd = re.compile(SUSPECT)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            at = 0
            while at < len(bodies):
                size, end = 0, at
                while end < len(bodies) and (end == at or size + len(bodies[end]) <= CHUNK):
                    size += len(bodies[end])
                    end += 1
                texts = [words.without_form(items.mend(t, token) if not t.isascii() and odd.search(t) else t, items.labels) for t in bodies[at:end]]
                h, starts, cues = words.word_hashes(texts)
                pairs = sorted(_search(h, starts, cues, items)) if len(h) and len(wanted) else []
                if pairs:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at + a for a, _ in pairs])), names.take(pa.array([b for _, b in pairs]))], names=["d", "i"])
                at = end

    return spread(read).mapInArrow(run, f"d {read.schema['d'].dataType.simpleString()}, i {kind.simpleString()}")
