import re

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skeinworks.llm import encoding

CLEAN = ["Le café est fermé", "Une école près du théâtre", "der Müller hört die Glocke", "über die Straße", "Почему портной купил окно", "Это моя книга", "niño señor canción", "żołnierz kupił łódkę", "don’t worry", "“Quote” — yes…"]


def garble(text, *chain):
    for a, b in zip(chain[::2], chain[1::2]):
        text = encoding.read_as(text.encode(a), b)
    return text


def corpus(spark, extra):
    rows = [(i, t) for i, t in enumerate(CLEAN * 4)] + [(1000 + i, t) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, "doc_id long, text string")


CASES = [
    garble("Le café est fermé", "utf-8", "cp1252"),
    garble("Une école près du théâtre", "utf-8", "latin-1"),
    garble("der Müller hört die Glocke", "cp1252", "cp850"),
    garble("über die Straße", "utf-8", "mac_roman"),
    garble("Почему портной купил окно", "cp1251", "cp1252"),
    garble("Это моя книга", "koi8-r", "cp1251"),
    garble("niño señor canción", "utf-8", "cp1252", "utf-8", "cp1252"),
    garble("żołnierz kupił łódkę", "cp1250", "cp1252"),
    garble("don’t worry", "utf-8", "cp1252"),
    garble("“Quote” — yes…", "utf-8", "cp1250"),
]
LOST = [garble("Le café est fermé", "cp1252", "utf-8"), "plötzlich " + "�"]
RIGHT = ["Ångström 5 °C", "π and √2, ½ of £4", "Ráp1do", "﻿Le café", "naïve Žižek", "№ 5 ©", "É ÇA", "ASCII only", "", None, "x" * 100_000 + " café"]


def test_found_and_restored(spark):
    df = corpus(spark, CASES + LOST + RIGHT)
    ids = {r["doc_id"] for r in encoding.affected(df, "doc_id", "text").collect()}
    assert ids == {1000 + i for i in range(len(CASES) + len(LOST))}
    back = {r["doc_id"]: (r["restored_text"], r["complete"]) for r in encoding.restored(df, "doc_id", "text").collect()}
    wanted = CLEAN[:1] + CLEAN[1:2] + CLEAN[2:3] + CLEAN[3:4] + CLEAN[4:5] + CLEAN[5:6] + CLEAN[6:7] + CLEAN[7:8] + CLEAN[8:9] + CLEAN[9:10]
    assert [back[1000 + i] for i in range(len(wanted))] == [(w, True) for w in wanted]


def test_paths(spark):
    """The table of forms explains every token whose word is known; characters only the others."""
    rare = [garble("prétérition", "utf-8", "cp1252"), garble("Le café hivérnal", "utf-8", "mac_roman")]
    texts = encoding.text_tokens(corpus(spark, [*CASES, *LOST, *rare]), "text")
    paths = {r["token"]: (r["path"], r["original"]) for r in encoding.garbled_tokens(texts).collect()}
    assert sorted((v for v in paths.values() if v[0] != "word"), key=str) == [("characters", "hivérnal"), ("characters", "prétérition"), ("lost", None)]
    assert sum(v[0] == "word" for v in paths.values()) >= 25


@pytest.mark.parametrize("sign", ["√2", "£4", "½", "°C", "©", "♪"])
def test_signs(spark, sign):
    """Signs that stand with digits or letters are known from where they are intact."""
    wrong = [garble(f"7 {sign} more", *chain) for chain in (("utf-8", "cp1252"), ("utf-8", "cp437")) if sign != "½"]
    df = corpus(spark, [f"again {sign} here", f"and {sign} there", f"{sign} once more", *wrong])
    assert {r["doc_id"] for r in encoding.affected(df, "doc_id", "text").collect()} == {1003 + i for i in range(len(wrong))}


def test_short_words_vouch_for_no_sign(spark):
    """A misread short word is not taken for an even shorter one and a sign."""
    df = corpus(spark, ["Ià", *["I… and I… again"] * 5])
    assert encoding.affected(df, "doc_id", "text").collect() == []


def test_edges(spark):
    empty = corpus(spark, []).limit(0)
    assert encoding.affected(empty, "doc_id", "text").collect() == []
    assert encoding.restored(empty, "doc_id", "text").collect() == []
    df = corpus(spark, [CASES[0], CASES[0]]).withColumnRenamed("doc_id", "token")
    assert {r["token"] for r in encoding.affected(df, "token", "text").collect()} == {1000, 1001}


@given(st.lists(st.none() | st.text("aZ09 é-ß\n\x85\x80ж𝒳…'", max_size=12), max_size=8))
def test_tokens(texts):
    got = encoding.tokens_of(pa.array(texts, pa.string())).to_pylist()
    assert got == [re.findall(encoding.TOKEN, t or "") for t in texts]


MANY = "Почему портной Алексей вчера купил Ивану четыре окна"


@pytest.mark.parametrize("tail", ["", " {i}"])
@pytest.mark.parametrize("chain", [("cp1251", "cp1252"), ("koi8-r", "cp1251")])
def test_garbled_more_often_than_intact(spark, tail, chain):
    """Copies of a wrongly read text, equal or each its own, outnumber the intact ones."""
    wrong = [(i, garble(MANY, *chain) + tail.format(i=i)) for i in range(40)]
    df = spark.createDataFrame([*wrong, (100, MANY), (101, MANY + " 1"), (102, "Это моя книга")], "doc_id long, text string")
    assert {r["doc_id"] for r in encoding.affected(df, "doc_id", "text").collect()} == set(range(40))
    back = {r["doc_id"]: r["restored_text"] for r in encoding.restored(df, "doc_id", "text").collect()}
    assert back == {i: MANY + tail.format(i=i) for i in range(40)}


@pytest.mark.parametrize("word", ["café", "КНИГА", "Straße", "łódkę"])
def test_plain(word):
    assert encoding.plain_word(word) and encoding.garbled_forms(word) and word not in encoding.garbled_forms(word)


@pytest.mark.parametrize("word", ["cafÃ©", "caFé", "мir", "a1", "³x"])
def test_not_plain(word):
    assert not encoding.plain_word(word)
