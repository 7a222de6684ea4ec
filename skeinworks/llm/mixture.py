"""Combining sources to target shares of all tokens.

Records of the same text are one document; the sources that hold it are its
membership pattern.  Documents are summed up by pattern, and a min-cost flow routes
the tokens of the patterns to the quotas of the sources: a document's first use is
free, each further one dearer, up to the source's cap.  The largest total that all
quotas allow is found from the cuts that keep a larger one from flowing.  Within a
pattern, documents take their turn in a seeded order.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.session import only, quoted, spread, stage

#: Where the public tokenizers' files are by default.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts text before its merges.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Target sources, and membership patterns, up to which the flow is solved as it is.
MOST_SOURCES, MOST_PATTERNS = 10_000, 20_000
#: Bits of the hash ranges (65,536) in which the documents of a pattern are put in order.
RANGE_BITS = 16


def token_counts(df: DataFrame, id_column: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``id``, ``source``, ``text_hash``, ``n_tokens``) of every record; a null text has none.

    ``tokenizer`` is a file of the driver's, which is sent to the executors.
    """
    df = only(df, id_column, text, source)
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    read = df.select(quoted(id_column).cast("long").alias("id"), quoted(source).cast("string").alias("source"), F.md5(quoted(text).cast("string")).alias("text_hash"), quoted(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("counts", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            counts = [0 if t is None else len(encoder.encode_ordinary(t)) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64())], names=["id", "source", "text_hash", "n_tokens"])

    return spread(read).mapInArrow(run, "id bigint, source string, text_hash string, n_tokens bigint")


class _Flow:
    """Successive shortest paths on a small graph with integer capacities."""

    def __init__(self):
        self.edges: list[list] = []  # [to, capacity left, cost]; the reverse of edge i is i ^ 1
        self.out: dict = {}

    def add(self, a, b, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.edges.append([y, c, w])
            self.out.setdefault(x, []).append(len(self.edges) - 1)
        return len(self.edges) - 2

    def run(self, source, sink, most: int) -> int:
        sent = 0
        while sent < most:
            cost, via, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out.get(x, ()):
                    y, left, w = self.edges[e]
                    if left > 0 and cost[x] + w < cost.get(y, 1 << 60):
                        cost[y], via[y] = cost[x] + w, e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if sink not in via:
                break
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.edges[via[x] ^ 1][0]
            amount = min(most - sent, *(self.edges[e][1] for e in path))
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount
            sent += amount
        return sent

    def reachable(self, start) -> set:
        """Where more could still flow to: one side of a smallest cut."""
        seen, todo = {start}, [start]
        while todo:
            for e in self.out.get(todo.pop(), ()):
                y, left, _ = self.edges[e]
                if left > 0 and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen


def quotas_of(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole tokens for each share of a total; what rounding leaves goes to the largest remainders."""
    exact = {s: x * total for s, x in shares.items()}
    out = {s: int(x) for s, x in exact.items()}
    left = round(sum(exact.values())) - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, left)]:
        out[s] += 1
    return out


def _network(patterns, repeats, quotas, costs: bool) -> tuple[_Flow, dict, dict]:
    flow, routes, sinks = _Flow(), {}, {}
    for p, tokens in sorted(patterns.items()):
        laps = max(repeats[s] for s in p)
        if costs:
            for k in range(laps):
                flow.add("from", ("pattern", p), tokens, k * k)  # convex: evenly spread repetition is cheapest
        else:
            flow.add("from", ("pattern", p), tokens * laps)
        for s in p:
            routes[p, s] = flow.add(("pattern", p), ("source", s), tokens * repeats[s])
    for s, quota in quotas.items():
        sinks[s] = flow.add(("source", s), "to", quota)
    return flow, routes, sinks


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Min-cost flow of pattern tokens to source quotas; the amount sent and each route's."""
    flow, routes, _ = _network(patterns, repeats, quotas_of(shares, total), True)
    sent = flow.run("from", "to", 1 << 60)
    return sent, {key: flow.edges[e ^ 1][1] for key, e in routes.items()}


def largest_total(patterns, shares, repeats) -> int:
    """The largest total of which every source's quota can be filled.

    Begun with all tokens there are: where the quotas of a total don't fit, the smallest
    cut names the sources that lack tokens, and the total that the cut would allow is
    tried next.  Few cuts do, as each is of other sources.
    """
    total = int(sum(t * max(repeats[s] for s in p) for p, t in patterns.items()) / max(sum(shares.values()), 1e-12))
    while total > 0:
        quotas = quotas_of(shares, total)
        flow, routes, sinks = _network(patterns, repeats, quotas, False)
        if flow.run("from", "to", 1 << 60) == sum(quotas.values()):
            return total
        reached = flow.reachable("from")
        short = [s for s in shares if ("source", s) not in reached]  # their whole inflow is the cut
        room = sum(t * max(repeats[s] for s in p) for p, t in patterns.items() if ("pattern", p) not in reached)
        room += sum(patterns[p] * repeats[s] for p, s in routes if ("pattern", p) in reached and ("source", s) not in reached)
        total = min(total - 1, int(room / sum(shares[s] for s in short)))
    return 0


def mix(counted: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """(``id``, ``source``, ``copies``, ``n_tokens``): which documents to use, for which source, how often.

    ``counted``: as ``token_counts`` gives it; ``targets``: ``source``, ``target_share``,
    ``max_repeats``.  Without ``total_tokens`` the total is the largest at which all
    shares can be met; a larger one asked for fills what it can.  A source misses its
    quota by less than two documents, as documents are used whole.  Sources that have
    no token at all are left out, the others keep their shares in relation to each
    other; ``reached`` reports them as not ``fillable``.

    * Records without a source or text, or of a source without target, are not used.
    * Records of the same text are one document, used under the smallest id, at most
      ``max_repeats`` times for a source and, over all its sources, at most the
      largest of their caps.
    * Targets with a null share or share 0 take nothing; repeated target rows are an
      error, as are shares that add up to more than 1 (ValueError).
    * Empty tables, or targets none of which has a token, give an empty result.

    Only the sums by pattern come to the driver: the ``MOST_PATTERNS`` largest.  Were
    there more, documents of the further patterns are used for the scarcest of their
    sources only: shares and caps hold as before, the total may be a little smaller.
    """
    goal = targets.select("source", "target_share", "max_repeats").where("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL").limit(MOST_SOURCES + 1).collect()
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    shares, repeats = {r[0]: float(r[1]) for r in goal}, {r[0]: int(r[2]) for r in goal}
    if len(shares) < len(goal) or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("target sources must be distinct and their shares add up to at most 1")
    wanted = counted.where(F.col("source").isin(*shares) & F.col("text_hash").isNotNull()) if shares else counted.where("false")
    documents = stage(wanted.groupBy("text_hash").agg(F.min("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set("source")).alias("pattern")).where("n_tokens > 0"))
    place = F.xxhash64(F.lit(seed), "text_hash")
    documents, patterns = _with_patterns(documents, shares)
    documents = documents.withColumns({"place": place, "range": F.shiftrightunsigned(place, 64 - RANGE_BITS)})
    held = {s for p in patterns for s in p}
    shares = {s: x for s, x in shares.items() if s in held}
    total = largest_total(patterns, shares, repeats) if total_tokens is None else total_tokens
    routes = route(patterns, shares, repeats, total)[1] if total else {}
    # On the line of a pattern's uses (its tokens, lap after lap) each source gets a segment.
    segments, at = [], {}
    for (p, s), amount in sorted(routes.items()):
        if amount:
            begin = at.get(p, 0)
            segments.append((list(p), s, begin, begin + amount, patterns[p]))
            at[p] = begin + amount
    spark = counted.sparkSession
    line = spark.createDataFrame(segments, "pattern array<string>, source string, begin bigint, end bigint, lap bigint")
    # Where a document starts on the line: sums of the ranges before its own, and of its range up to it.
    ranges = documents.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "range").orderBy("place", "text_hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = documents.withColumn("inside", inside).join(ranges.select("pattern", "range", before.alias("before")), ["pattern", "range"]).withColumn("start", F.col("before") + F.col("inside"))
    starts_before = lambda x: F.greatest(F.lit(0), F.ceil((x - F.col("start")) / F.col("lap")))
    used = placed.join(F.broadcast(line) if len(segments) <= 5 * MOST_PATTERNS else line, "pattern").withColumn("copies", (starts_before(F.col("end")) - starts_before(F.col("begin"))).cast("int"))
    return used.where("copies > 0").select("id", "source", "copies", "n_tokens")


def _with_patterns(documents: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, dict[tuple[str, ...], int]]:
    """The documents, and the tokens of each pattern of sources."""
    sums = documents.groupBy("pattern").agg(F.sum("n_tokens").alias("t"))
    rows = sums.orderBy(F.size("pattern") > 1, F.desc("t"), "pattern").limit(MOST_PATTERNS + 1).collect()  # single sources first
    if len(rows) > MOST_PATTERNS:
        spark = documents.sparkSession
        kept = spark.createDataFrame([(list(r[0]), True) for r in rows[:MOST_PATTERNS]], "pattern array<string>, kept boolean")
        tokens = {r[0]: r[1] for r in sums.select(F.explode("pattern").alias("s"), "t").groupBy("s").agg(F.sum("t")).collect()}  # a row per target source
        need = spark.createDataFrame([(s, shares[s] / t) for s, t in tokens.items()], "s string, need double")
        scarcest = sums.select("pattern", F.explode("pattern").alias("s")).join(F.broadcast(need), "s").groupBy("pattern").agg(F.max_by("s", F.struct("need", "s")).alias("only"))
        further = scarcest.join(F.broadcast(kept), "pattern", "left_anti")
        documents = stage(documents.join(further, "pattern", "left").withColumn("pattern", F.when(F.col("only").isNotNull(), F.array("only")).otherwise(F.col("pattern"))).drop("only"))
        rows = documents.groupBy("pattern").agg(F.sum("n_tokens")).collect()  # the kept ones, and at most one per source
    return documents, {tuple(r[0]): int(r[1]) for r in rows}


def reached(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share, documents, uses, tokens, highest number of uses, and whether it had a document at all (``fillable``)."""
    by = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_uses"))
    rows = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").fillna(0, ["n_documents", "n_uses", "n_tokens", "most_uses"])
    whole = F.sum("n_tokens").over(Window.partitionBy())  # one row per target source
    return rows.withColumns({"share": F.try_divide(F.col("n_tokens").cast("double"), whole), "fillable": F.col("n_documents") > 0})
