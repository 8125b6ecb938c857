"""Listed strings inside texts: filters, rare substrings, both ways of meeting them."""

import random

import numpy as np
import pytest

from tabwise.operators import grams as G, sensitive as H


def test_rolling_hash_tells_substrings():
    r = random.Random(3)
    raw = bytes(r.choices(range(256), k=400)) + b"abcabcabc"
    for k, h in G.rolling(np.frombuffer(raw, np.uint8), [3, 5, 8]):
        by = {}
        for i, x in enumerate(h.tolist()):
            assert by.setdefault(raw[i:i + k], x) == x
        assert len(set(by.values())) == len(by)
    assert list(G.rolling(np.frombuffer(b"ab", np.uint8), [3])) == []


def case(seed):
    r = random.Random(seed)
    letters = "abé日 -"
    values = {"".join(r.choices(letters, k=r.randint(1, 16))).strip() for _ in range(150)} | {"the", "absent value", "日本語", "x" * 3_000}
    texts = ["".join(r.choices(letters, k=r.randint(0, 200))) for _ in range(150)] + ["the " * 400] * 60 + ["", None, "x" * 9_000, "日本語the", "\x00" * 5]
    return values, texts


@pytest.mark.parametrize("sent, block", [(G.SENT_BYTES, 2_000_000), (G.SENT_BYTES, 50), (0, 300)])
def test_against_brute_force(spark, monkeypatch, sent, block):
    monkeypatch.setattr(G, "BLOCK", block)
    values, texts = case(block)
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    vs = spark.createDataFrame([(v,) for v in [*values, " the ", None]], "v string")
    want = sorted((i, len({v for v in values if len(v) >= 3 and v in (t or "")})) for i, t in rows)
    assert sorted(tuple(x) for x in H.leak_scan(df, "id", "text", vs, "v", few=0, sent_bytes=sent).collect()) == want


def test_hot_substrings(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT", 100)
    monkeypatch.setattr(G, "SLICES", 4)
    rows = [(i, "common word " + str(i % 50)) for i in range(2_000)]
    vs = spark.createDataFrame([("common",), ("com",), ("word 49",), ("nothing",)], "v string")
    got = H.leak_scan(spark.createDataFrame(rows, "id int, text string"), "id", "text", vs, "v", few=0, sent_bytes=0)
    assert {r.id: r.leaked for r in got.collect()} == {i: 3 if i % 50 == 49 else 2 for i, _ in rows}


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("a", "text")], "id string, text string")
    for vs in ([], ["ab"], ["zzz"]):
        values = spark.createDataFrame([(v,) for v in vs], "v string")
        assert [tuple(r) for r in H.leak_scan(df, "id", "text", values, "v", few=-1).collect()] == [("a", 0)]
    assert H.leak_scan(df.limit(0), "id", "text", spark.createDataFrame([("abc",)], "v string"), "v", few=0).count() == 0
