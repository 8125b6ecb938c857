import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabwise.llm import mixture as M


def spark_hash(*values):
    """xxhash64 of int (4 bytes), long (8 bytes) and string columns, nulls left out."""
    h = 42
    for v, width in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if width == 0 else int(v).to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def level(sizes, weights, total, most):
    """Targets by bisecting the level that weights are raised to."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(most * s, high * w) for s, w in zip(sizes, weights)]


def brute(rows, seed=11):
    """(doc_id, source, size, source_size, target, copies) by walking sorted lists; equal rows are drawn together."""
    docs = [(spark_hash((seed, 4), (i, 8), (s, 0), (t or "", 0)), i, s, len((t or "").encode().split())) for i, t, s in rows]
    names = sorted({s for _, _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, _, s, n in docs if s == name) for name in names]
    targets = level(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)
    rng = np.random.default_rng(seed)
    out = []
    for name, source_size, target in zip(names, sizes, targets):
        target = round(target, 6)
        own = [d for d in docs if d[2] == name]
        passes = min(2, int(target // source_size)) if source_size else 0
        rest = target - passes * source_size
        n_blocks = max(1, min(M.MAX_BLOCKS, source_size // M.BLOCK_WORDS))
        block = {d[0]: spark_hash((seed + 1, 4), (d[0], 8)) % n_blocks for d in own}
        present = sorted(set(block.values()))
        extra, had = set(), 0
        for b in (present[j] for j in rng.permutation(len(present))):
            if had >= rest:
                break
            inside = sorted({(spark_hash((seed + 5, 4), (d[0], 8)) % M.KEYS, d[0]) for d in own if block[d[0]] == b})
            words = sum(d[3] for d in own if block[d[0]] == b)
            if had + words <= rest + 1e-6:
                extra |= {k for _, k in inside}
                had += words
                continue
            for _, k in inside:
                w = sum(d[3] for d in own if d[0] == k)
                if had + w > rest + 1e-6:
                    break
                extra.add(k)
                had += w
            gap = rest - had
            left = [(abs(d[3] - gap), d[0]) for d in own if d[0] not in extra and abs(d[3] - gap) < gap - 1e-9]
            if left and passes < 2:
                k = min(left)[1]
                if abs(sum(d[3] for d in own if d[0] == k) - gap) < gap:
                    extra.add(k)
            break
        out += [(i, s, n, source_size, target, passes + (k in extra)) for k, i, s, n in own]
    return out


def made(n=600, seed=2):
    r = random.Random(seed)
    rows = [(i, " ".join(["w%d" % r.randrange(99)] * r.randint(1, 80)), r.choice(["b", "b", "b", "b", "a", "ä", "Z", None])) for i in range(n)]
    # equal ids and texts in several sources, equal rows, and no words
    return rows + [(i, "same text here", s) for i in range(900, 930) for s in "abZ"] + [rows[0], rows[0], (5_000, None, "a"), (5_001, "", "e"), (None, "z " * 300, "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, source string, target string, _key int, Shard string").repartition(5)


def test_fill():
    sizes, weights = [100, 100, 1000, 10], [3.0, 1.0, 2.0, 3.0]
    t = M.fill(sizes, weights, 1.5 * sum(sizes), 2)
    assert np.allclose(t, level(sizes, weights, 1.5 * sum(sizes), 2)) and t[0] == 200 and t[3] == 20
    assert M.fill([], [], 0, 2) == [] and M.fill([0, 4], [1.0, 1.0], 6, 2) == [0.0, 6.0]
    assert M.fill([10, 10], [3.0, 1.0], 30, 2) == [20.0, 10.0]


def test_split_keeps_quotas():
    q = np.array([100, 3, 0, 57])
    leaf, who, n = M.split(q, 7, np.random.default_rng(1))
    out = np.zeros((7, 4), int)
    np.add.at(out, (leaf, who), n)
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (n > 0).all()
    assert all((a == b).all() for a, b in zip((leaf, who, n), M.split(q, 7, np.random.default_rng(1))))


@pytest.mark.parametrize("block, narrow", [(2_000, 4_096), (100, 4_096), (100_000, 4)])
def test_taken_against_brute_force(spark, monkeypatch, block, narrow):
    monkeypatch.setattr(M, "BLOCK_WORDS", block)
    monkeypatch.setattr(M, "NARROW", narrow)
    rows = made()
    got = M.plan_mixture(frame(spark, rows)).collect()

    def key(x):
        return tuple(str(v) for v in x)

    assert sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), len(r.shards)) for r in got), key=key) == sorted(brute(rows), key=key)
    by = {}
    for r in got:
        assert r.taken == r.size * len(r.shards) <= 2 * r.size
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 80 for (_, t), v in by.items())


def test_rows_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 100)
    rows = made()
    df = frame(spark, rows)
    for shard_words in (M.SHARD_WORDS, 500):
        monkeypatch.setattr(M, "SHARD_WORDS", shard_words)
        out = M.mix(df)
        assert out.columns == ["doc_id", "text", "source", "target", "_key", "Shard", "copy", "shard", "place"]
        got, plan, words, taken = [], [], {}, {}
        for r in out.toLocalIterator():
            got.append((r[0], r[2], r[7]))
            words[r[2]] = words.get(r[2], 0) + len((r[1] or "").split())
        for r in M.plan_mixture(df.repartition(2)).collect():
            plan += [(r.doc_id, r.source, s) for s in r.shards]
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert sorted(got, key=str) == sorted(plan, key=str)
        assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
        shards = {s for _, _, s in got}
        assert len(shards) > (60 if shard_words == 500 else 5)
        one = out.toDF(*"abcdef", "copy", "to", "place").withColumn("p", F.spark_partition_id()).groupBy("to").agg(F.count_distinct("p").alias("n"))
        assert one.agg(F.max("n")).first()[0] == 1


def test_edges(spark):
    schema = "doc_id long, text string, source string, Size int"
    assert M.plan_mixture(spark.createDataFrame([], schema)).count() == 0 and M.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a", 1), (2, "", "a", 2), (3, "x y", "b", None), (3, "x y", "b", None), (None, "z " * 5_000, None, 4), (4, None, None, 5)]
    out = M.plan_mixture(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 6 and all(r.taken <= 2 * r.size for r in out) and {r.target for r in out if r.source == "a"} == {0.0}
