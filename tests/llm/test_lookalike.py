"""Texts that look the same."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from nightloom.llm import lookalike as L

# The same print in several writings.
ALIKE = [
    ["Order of the court", "Оrder of thе соurt", "Order of the court", "Ord­er o​f the⁠ court﻿", "Ｏｒｄｅｒ ｏｆ ｔｈｅ ｃｏｕｒｔ", "Οrder οf the cοurt"],
    ["fine office", "ﬁne oﬃce", "fi‌ne office"],
    ["déjà über", "déjà über", "dе́jа̀ über"],
    ["Городской суд", "Гopoдcкoй cуд", "Городской суд"],
    ["Πρωτοδικείο", "Πpωτοδικείo", "Πρωτοδικείο"],
    ["а", "a"],
    ["ABC", "АВС", "ΑΒC"],
    ["co-op", "co‐op", "co‑op", "co－op"],
    ["K 5", "K 5"],
    ["one\ntwo", "one\r\ntwo", "one two"],
    ["ɑɡain", "again"],
    ["Qur'an VI", "Ԛur'аn ѴӀ"],
    ["lex et lis", "ӏex еt ӏіѕ"],
    ["Հանրապետություն օր", "Հանրապետություն oր"],
    ["각", "각", "가​ᆨ"],
]
DIFFERENT = ["Order", "order", "Orders", "Örder", "Order.", "Order\n", "Order 1", "Order  1", "Order ¹", "Ordër", "1/2", "½", "…", "...", "й", "и", "суд", "sud", "β", "ß"]


def test_alike():
    for group in ALIKE:
        assert len({L.canonical(t) for t in group}) == 1, [L.canonical(t) for t in group]


def test_readable():
    assert L.canonical("Гopoдcкoй cуд") == "Городской суд"
    assert L.canonical("Πpωτοδικείo") == "Πρωτοδικείο"
    assert L.canonical("Оrder") == "Order"


def test_different():
    forms = [L.canonical(t) for t in DIFFERENT]
    assert len(set(forms)) == len(forms)


def test_edges():
    assert L.canonical(None) is None and L.canonical("") == "" and L.canonical("​") == ""
    long = "Оrder " * 200_000
    assert L.canonical(long) == "Order " * 200_000


PIECES = st.lists(st.sampled_from(list("aeopcxyABEKMHOPCTX йсудЯωλοΑé́̈​­ -‐ﬁ\n.1Ａ") + ["ԁ", "ɡ", "ν", "v"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_idempotent_and_composed(text):
    once = L.canonical(text)
    assert L.canonical(once) == once and unicodedata.is_normalized("NFC", once)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.randoms())
def test_swapped_doubles(text, rng):
    """Replacing letters by their doubles, composing or decomposing, and adding unseen characters changes nothing."""
    doubles = {}
    for group in L.ALIKE.split():
        letters = list(group)
        for c in letters:
            doubles[c] = letters
    other = "".join(rng.choice(doubles.get(c, [c])) + rng.choice(["", "", "‍"]) for c in unicodedata.normalize(rng.choice(["NFC", "NFD"]), text))
    assert L.canonical(other) == L.canonical(text)


def test_pairs(spark):
    rows = [(i, t) for i, t in enumerate(t for g in ALIKE for t in g)] + [(100, "Order of the court"), (101, None), (102, ""), (103, "​"), (None, "fine office"), (100, "Order of the court")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("look", F_lit(1)).withColumn("writing", F_lit(1))
    got = {tuple(r) for r in L.alike_pairs(df, "id", "text").collect()}
    texts = [(i, t) for i, t in dict(rows).items() if i is not None and t is not None]
    want = {(min(i, j), max(i, j)) for i, a in texts for j, b in texts if i < j and a != b and L.canonical(a) == L.canonical(b)}
    assert got == want and (102, 103) in got
    assert L.alike_pairs(df.limit(0), "id", "text").count() == 0


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ae1̣́̇  ​가각аο\n", max_size=6), max_size=8))
def test_seams_alone_give_the_whole(pieces):
    """Pieces that are composed each, put together, equal the normal form of the whole."""
    composed = [unicodedata.normalize("NFC", p) for p in pieces]
    assert L._spliced(composed) == unicodedata.normalize("NFC", "".join(composed))


def test_classes(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(t for g in ALIKE for t in g)] + [(100, "Order of the court"), (101, None), (None, "x"), (100, "Order of the court"), *((200 + i, "copied") for i in range(30)), (300, "сopied")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    texts = {(i, t) for i, t in rows if i is not None and t is not None}
    want = set()
    for i, t in texts:
        alike = [(j, u) for j, u in texts if L.canonical(u) == L.canonical(t)]
        want.add((i, min(j for j, _ in alike), len(alike), sum(u != t for _, u in alike)))
    for crowd in (100_000, 10):
        monkeypatch.setattr(L, "_CROWD", crowd)
        got = L.alike_classes(df, "id", "text").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert L.alike_classes(df.limit(0), "id", "text").count() == 0


def test_column(spark):
    df = spark.createDataFrame([("Оrder", 1), ("plain", 2), ("tab\there", 3), ("cr\r\n", 4), (None, 5)], "text string, canonical int")
    got = [r.canonical for r in L.canonical_text(df, "text", "canonical").collect()]
    assert got == ["Order", "plain", "tab\there", "cr\n", None]
