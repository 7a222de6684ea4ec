import base64
import random

import pytest
import tiktoken

from skeinworks.llm import mixture
from skeinworks.llm.queries import QUERIES

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)]


def counted(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, text_hash string, n_tokens long")


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares(spark):
    rows = [(i, "a", f"a{i}", 10 + i % 7) for i in range(400)] + [(1000 + i, "b", f"b{i}", 9) for i in range(40)] + [(2000 + i, "c", f"c{i}", 11) for i in range(90)]
    mixed = mixture.mix(counted(spark, rows), targets(spark))
    by = {r["source"]: r for r in mixture.reached(mixed, targets(spark)).collect()}
    for s, share, cap in TARGETS:
        assert abs(by[s]["share"] - share) < 0.01 and by[s]["most_uses"] <= cap
    assert by["b"]["n_uses"] == 120  # the scarcest source sets the total
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixture.mix(counted(spark, rows), targets(spark)).collect()))
    other = mixture.mix(counted(spark, rows), targets(spark), seed=12)
    assert {r["id"] for r in other.collect()} != {r["id"] for r in mixed.collect()}


def test_overlap(spark):
    """Texts held by two sources serve the one that needs them."""
    rows = [(i, "a", f"t{i}", 10) for i in range(100)] + [(500 + i, "b", f"t{i}", 10) for i in range(100)] + [(900 + i, "c", f"c{i}", 10) for i in range(100)]
    mixed = mixture.mix(counted(spark, rows), targets(spark, [("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.25, 1)]))
    uses = {}
    for r in mixed.collect():
        uses[r["id"]] = uses.get(r["id"], 0) + r["copies"]
    by = {r["source"]: r["n_tokens"] for r in mixture.reached(mixed, targets(spark, [("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.25, 1)])).collect()}
    assert max(uses.values()) == 1 and all(i < 500 or i >= 900 for i in uses)
    assert abs(by["a"] - 2 * by["b"]) <= 30 and by["a"] + by["b"] >= 970


def test_absent_source(spark):
    """A target without a token takes nothing; the others keep their shares to each other."""
    rows = [(i, "a", f"a{i}", 10) for i in range(400)] + [(1000 + i, "b", f"b{i}", 10) for i in range(90)] + [(5000, "c", "empty", 0)]
    by = {r["source"]: r for r in mixture.reached(mixture.mix(counted(spark, rows), targets(spark)), targets(spark)).collect()}
    assert (by["b"]["n_uses"], by["a"]["n_tokens"], by["c"]["n_tokens"]) == (240, 4000, 0)
    assert abs(by["a"]["share"] - 0.5 / 0.8) < 0.01 and [by[s]["fillable"] for s in "abc"] == [True, True, False]


@pytest.mark.parametrize("most", [20_000, 4, 3])
def test_many_patterns(spark, monkeypatch, most):
    """Beyond the bound on patterns shares and caps hold and no document is lost to the mixture."""
    monkeypatch.setattr(mixture, "MOST_PATTERNS", most)
    rng = random.Random(3)
    rows, i = [], 0
    for t in range(900):
        for s in rng.choice([["a"], ["b"], ["c"], ["a", "b"], ["b", "c"], ["a", "b", "c"], ["a", "c"]]):
            rows.append((i, s, f"t{t}", 5 + t % 9))
            i += 1
    mixed = mixture.mix(counted(spark, rows), targets(spark))
    by = {r["source"]: r for r in mixture.reached(mixed, targets(spark)).collect()}
    for s, share, cap in TARGETS:
        assert abs(by[s]["share"] - share) < 0.01 and by[s]["most_uses"] <= cap
    assert sum(r["n_tokens"] for r in by.values()) > 9000


def test_shares_recomputed(spark):
    """Shares, caps and choice over all documents of sf0.01, from the chosen ids and the texts alone."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()
    wanted = {r["source"]: r for r in spark.read.parquet(f"{d}/mix_targets.parquet").collect()}
    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("t", pat_str=mixture.CUT, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in rows}
    sources = {}
    for r in rows:
        sources.setdefault(r["text"], set()).add(r["source"])
    first, again = ([tuple(r) for r in QUERIES["p8_mixture"](spark, d).select("id", "source", "copies", "n_tokens").collect()] for _ in range(2))
    assert sorted(first) == sorted(again) and first
    tokens, uses = {}, {}
    for i, s, n, size in first:
        assert s in sources[text[i]] and 1 <= n <= wanted[s]["max_repeats"] and size == len(encoder.encode_ordinary(text[i]))
        tokens[s] = tokens.get(s, 0) + n * size
        uses[text[i]] = uses.get(text[i], 0) + n
    assert all(n <= max(wanted[s]["max_repeats"] for s in sources[t] if s in wanted) for t, n in uses.items())
    longest, whole = max(x[3] for x in first), sum(tokens.values())
    assert all(abs(tokens[s] - w["target_share"] * whole) <= 3 * longest for s, w in wanted.items())


def test_edges(spark):
    rows = [(1, "a", "x", 5), (2, "a", "x", 5), (3, None, "y", 5), (4, "zzz", "z", 5), (5, "b", None, 0), (6, "b", "w", 0), (7, "c", "v", 4)]
    mixed = mixture.mix(counted(spark, rows), targets(spark, [("a", 0.5, 2), ("c", 0.5, 2), ("none", 0.0, 1)]))
    assert {r["id"] for r in mixed.collect()} <= {1, 7}
    assert mixture.mix(counted(spark, []), targets(spark)).collect() == []
    assert mixture.mix(counted(spark, rows), targets(spark, [])).collect() == []
    with pytest.raises(ValueError):
        mixture.mix(counted(spark, rows), targets(spark, [("a", 0.9, 1), ("b", 0.9, 1)]))
    with pytest.raises(ValueError):
        mixture.mix(counted(spark, rows), targets(spark, [("a", 0.1, 1), ("a", 0.1, 1)]))


def test_flow_is_cheapest():
    patterns, shares, repeats = {("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    total = mixture.largest_total(patterns, shares, repeats)
    sent, routes = mixture.route(patterns, shares, repeats, total)
    assert sent == total == 220
    assert all(0 <= x for x in routes.values())


def test_largest_total_against_search():
    """The cuts find what trying every total finds."""
    rng = random.Random(4)
    for _ in range(60):
        names = "abcde"[: rng.randrange(1, 6)]
        weights = [rng.randrange(1, 9) for _ in names]
        shares = {s: w / sum(weights) for s, w in zip(names, weights)}
        repeats = {s: rng.randrange(1, 4) for s in names}
        patterns = {(s,): rng.randrange(1, 60) for s in names if rng.random() < 0.8}
        for _ in range(3):
            patterns[tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1))))] = rng.randrange(1, 60)
        shares = {s: x for s, x in shares.items() if any(s in p for p in patterns)}
        fits = [t for t in range(sum(patterns.values()) * 15) if mixture.route(patterns, shares, repeats, t)[0] == sum(mixture.quotas_of(shares, t).values())] if sum(patterns.values()) < 60 else None
        got = mixture.largest_total(patterns, shares, repeats)
        assert mixture.route(patterns, shares, repeats, got)[0] == sum(mixture.quotas_of(shares, got).values())
        assert fits is None or got >= max(fits) - len(names)


@pytest.mark.parametrize("total", [0, 1, 7, 100, 12345])
def test_quotas(total):
    shares = {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}
    got = mixture.quotas_of(shares, total)
    assert sum(got.values()) == total and max(got.values()) - min(got.values()) <= 1


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, "", "a"), (3, None, None), (4, "a " * 50_000, "b")], "doc_id long, text string, source string")
    got = {r["id"]: (r["n_tokens"], r["source"]) for r in mixture.token_counts(df, "doc_id", "text", "source").collect()}
    assert got[1] == (2, "a") and got[2][0] == 0 and got[3] == (0, None) and got[4][0] > 40_000
