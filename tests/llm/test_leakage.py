import random

import numpy as np
import pytest

from skeinworks.llm import leakage, words

ITEM = "In 1403 Delabergei replaced every generous ladder with 98 barrels, the balcony and one lonely kettle; the Braowick chronicle says Ulmekas somehow traded 50 broken hammers."
OTHER = "Nenne die Übung, Galodra bewacht der Müller hinter die Straße von Murumoutho für 87 Taler. Wann öffnet das Öl aus Holograd 31 Säcke, die Kelaloil natürlich prüft?"
NOISE = "the a his her our old new green mill boat river tower never often sold bought saw lost near behind".split()


def cues(text, rng=None, per=5, fmt=lambda t: t):
    w = text.split()
    out = []
    for i in range(0, len(w), per):
        out.append(f"{i + 1}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{fmt(' '.join(w[i : i + per]))}\n")
    return "\n".join(out)


def around(passage, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choices(NOISE, k=30)) + " " + passage + " " + " ".join(rng.choices(NOISE, k=30))


def find(spark, texts, items=((1, ITEM), (2, OTHER))):
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(items), "item_id long, item_text string")
    return {tuple(r) for r in leakage.leaks(corpus, "doc_id", "text", table, "item_id", "item_text").collect()}


def test_forms(spark):
    w = ITEM.split()
    half = " ".join(w[3:18])
    texts = [
        cues(around(ITEM)),
        cues(around(half)),
        cues(around(ITEM.upper()), fmt=lambda t: f"<i>- {t}</i>"),
        cues(around(ITEM), fmt=lambda t: f"GALIL: {t} [music]"),
        cues(around(ITEM.replace("ladder", "laddcr").replace("lonely", "loneIy").replace("kettle", "kctt1e").replace("hammers", "harnrners"))),
        cues(around(" ".join(w[3:10]))),  # a short quote
        cues(around(" ".join(x for x in random.Random(1).sample(w, len(w))))),  # its words in another order
        cues(around(OTHER.encode().decode("cp1252", "replace"))),
        cues(around(OTHER.encode().decode("latin-1"))),
        cues(around(OTHER.encode("cp1252").decode("cp850"))),
        cues(around("Im " + OTHER.replace("ü", "u").replace("ö", "o").replace("Ü", "U"))),
        cues(around(" ".join(w[:8] + ["quite"] + w[8:]))),
        cues(around(" ".join(x if i % 4 else "wrong" for i, x in enumerate(w)))),
        cues(around(" ".join(w[:13]))) + "\n\n99\n00:01:00,000 --> 00:01:01,000\nDownloaded from x.example - rate it!\n\n" + cues(" ".join(w[13:])),
        "",
        None,
        "x" * 300_000 + " " + ITEM,
    ]
    want = {(i, 1) for i in (0, 1, 2, 3, 4, 11, 13, 16)} | {(i, 2) for i in (7, 8, 9, 10)}
    assert find(spark, texts) == want


def test_repeats_and_edges(spark):
    corpus = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "y"), (2, ITEM, "z")], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (None, ITEM), (9, ""), (10, "too short")], "item_id long, item_text string")
    assert {tuple(r) for r in leakage.leaks(corpus, "doc_id", "text", table, "item_id", "item_text").collect()} == {(1, 7), (2, 7)}
    assert leakage.leaks(corpus.limit(0), "doc_id", "text", table, "item_id", "item_text").collect() == []
    assert leakage.leaks(corpus, "doc_id", "text", table.limit(0), "item_id", "item_text").collect() == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 2)
    items = [(i, t) for i, t in enumerate([ITEM, OTHER, ITEM, OTHER, ITEM])]
    assert find(spark, [cues(ITEM), cues(OTHER)], items) == {(0, 0), (0, 2), (0, 4), (1, 1), (1, 3)}


def edits(rng, w, share, other=None):
    other = other or (lambda: 10_000 + rng.randrange(1000))
    out = list(w)
    for _ in range(int(len(w) * share)):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = other()
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, other())
    return out


@pytest.mark.parametrize("target", [0.9, 0.995])
def test_target_recall(target):
    """The walks reach the target on random words, in trials they were not chosen with, and none is wasted."""
    walks = leakage.walks_for(12, target)
    assert leakage.simulated_recall(leakage._Plan(12, walks), 12, trials=1500, seed=77) >= target - 0.02
    assert walks <= leakage.walks_for(12, 0.995) <= 5


def vocabulary(rng, n):
    return ["".join(rng.choices("abcghijkmnopqrstuvwxyz", k=9)) for _ in range(n)]


def end_to_end(spark, trials):
    """Share of (item words, passage words) trials found by ``leaks``, each in a text of its own, of those the exact check accepts alone."""
    found = find(spark, [cues(" ".join(p)) for _, p in trials], [(i, " ".join(w)) for i, (w, _) in enumerate(trials)])
    hash_of = lambda w: words.word_hashes([" ".join(w)])[0]
    true = {(i, i) for i, (w, p) in enumerate(trials) if leakage.agree(hash_of(w), hash_of(p))}
    assert true <= found or len(found & true) / len(true) >= 0.98
    return len(true)


def test_recall_end_to_end(spark):
    """Recall against the exact check over whole texts, for items of many lengths and passages of half or all of them."""
    rng = random.Random(9)
    trials = []
    for n in (20, 24, 27, 33, 38, 60, 120) * 40:
        w = vocabulary(rng, n)
        size = rng.choice([-(-n // 2), n, rng.randrange(-(-n // 2), n + 1)])
        at = rng.randrange(n - size + 1)
        passage = edits(rng, w[at : at + size], 0.1, lambda: vocabulary(rng, 1)[0])
        trials.append((w, vocabulary(rng, 40) + passage + vocabulary(rng, 40)))
    assert end_to_end(spark, trials) >= 150


@pytest.mark.parametrize("inserted", [32, 40])
def test_long_items(spark, inserted):
    """The band follows the item's own tolerance: words inserted all over a long item."""
    rng = random.Random(inserted)
    trials = []
    for _ in range(12):
        w = vocabulary(rng, 400)
        passage = list(w)
        for _ in range(inserted):
            passage.insert(rng.randrange(len(passage)), vocabulary(rng, 1)[0])
        trials.append((w, vocabulary(rng, 30) + passage + vocabulary(rng, 30)))
    assert end_to_end(spark, trials) == 12


def test_short_items(spark):
    """Items of a few words, or one, are found wherever half of them stands."""
    rng = random.Random(6)
    trials = [(w, vocabulary(rng, 20) + w[: rng.choice([n, -(-n // 2)])] + vocabulary(rng, 20)) for n in (1, 2, 3, 4, 5, 6, 8, 10, 13, 15, 18) for _ in range(6) for w in [vocabulary(rng, n)]]
    assert end_to_end(spark, trials) == len(trials)


def cue(n, text):
    return f"{n}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n{text}\n\n"


@pytest.mark.parametrize("parts, between, found", [
    ((13, 26), ["Whatever stands here, at any length"], True),
    ((13, 26), ["♪ a song ♪", "♪ of two cues ♪"], True),
    ((13, 26), ["four words stand here", "and four words here", "three cues are several"], False),
    ((7, 16), ["right in the middle of a half"], True),
    ((13, 26), [], True),
])
def test_whole_cues_between(spark, parts, between, found):
    """A passage parted by whole cues, whatever they say."""
    w = vocabulary(random.Random(2), 30)
    a, z = parts
    text = cue(1, "before") + cue(2, " ".join(w[max(0, a - 10) : a])) + "".join(cue(3 + i, t) for i, t in enumerate(between)) + cue(9, " ".join(w[a:z])) + cue(10, "after it all")
    assert find(spark, [text], [(1, " ".join(w))]) == ({(0, 1)} if found else set())


def test_words_between_in_a_cue(spark):
    """The same words inside a cue are errors."""
    w = vocabulary(random.Random(2), 30)
    assert find(spark, [cue(1, " ".join(w[3:13]) + " six words that are no cue " + " ".join(w[13:20]))], [(1, " ".join(w))]) == set()


def test_ids_of_any_type(spark):
    corpus = spark.createDataFrame([("x", ITEM)], "doc_id string, text string")
    table = spark.createDataFrame([("i", ITEM)], "item_id string, item_text string")
    assert [tuple(r) for r in leakage.leaks(corpus, "doc_id", "text", table, "item_id", "item_text").collect()] == [("x", "i")]


def brute(item, doc):
    """Every stretch of both, by edit distance (small inputs)."""
    n, m = len(item), len(doc)
    for a in range(n):
        for b in range(a + -(-n // 2), n + 1):
            for c in range(m):
                row = list(range(b - a + 1))
                for d in range(c, m):
                    new = [row[0] + 1]
                    for i in range(b - a):
                        new.append(min(row[i] + (item[a + i] != doc[d]), row[i + 1] + 1, new[i] + 1))
                    row = new
                    if row[-1] <= 0.1 * (b - a) + 1e-9:
                        return True
    return False


def test_agree_against_brute_force():
    rng = random.Random(10)
    seen = set()
    for _ in range(250):
        item = [rng.randrange(60) for _ in range(12)]
        doc = [rng.randrange(60, 90) for _ in range(2)] + edits(rng, item[rng.randrange(3) : 12 - rng.randrange(7)], rng.choice([0, 0.1, 0.3])) + [rng.randrange(60, 90) for _ in range(2)]
        want = brute(item, doc)
        seen.add(want)
        assert leakage.agree(np.array(item, np.uint64), np.array(doc, np.uint64)) == want, (item, doc)
    assert seen == {True, False}


@pytest.mark.parametrize("a, b", [("Straße", "STRASSE"), ("corner", "comer"), ("clear", "dear"), ("Fuß", "FUSS"), ("été", "ete"), ("hill", "1iill"), ("Holland", "Ho|Iand"), ("𐐀𐐁", "𐐨𐐩"), ("wave", "vvavc")])
def test_words_that_agree(a, b):
    h, *_ = words.word_hashes([a, b])
    assert len(h) == 2 and h[0] == h[1]


def test_words_that_do_not():
    h, starts, _ = words.word_hashes(["86 88 ladder letter", "", "x"])
    assert len(set(h.tolist())) == 5 and starts.tolist() == [0, 4, 4, 5]
    h, starts, cues_at = words.word_hashes(["\x1ea b\x1e\x1ec", "𠀀 𠀁\x1e d"])  # beyond the first plane
    assert len(set(h.tolist())) == 6 and starts.tolist() == [0, 3, 6] and cues_at.tolist() == [0, 2, 2, 5]
