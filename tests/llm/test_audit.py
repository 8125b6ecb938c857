import random
import re
from itertools import permutations

from tabwise.llm import audit as A
from tabwise.operators.sieve import passing, sieve
from pyspark.sql import functions as F


def brute(rows, labels):
    labels = [x for x in labels if x[0] is not None]
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(i, t or "", s or "") for i, t, s in rows]
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t] = min(low.get(t, i), i)

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and low[t] < i}

    judged = [(s, i, fails(i, t)) for i, t, s in rows]
    out, shap = {}, {}
    for part in {s for _, _, s in rows}:
        own = [(i, f) for s, i, f in judged if s == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[k] for _, f in own) - len(gone), sum(f[k] and sum(f.values()) == 1 for _, f in own),
                                                   sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
                shap[part, k] = shap.get((part, k), 0) + len(gone)
    return {(p, o, s, *v, shap[p, o[s - 1]]) for (p, o, s), v in out.items()}


def made(n, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choices(["ab", "Cd", "é", "x1", "#", "z|", "LONG"] + ["w%d" % i for i in range(80)], k=r.choice([3, 49, 50, 51, 80]))) for _ in range(n // 3)] + ["", " \t\x0b", "AAAAA" + "b" * 95, "AAAAAA" + "b" * 94]
    rows = [(i, r.choice(pool), r.choice(["s", "t", "", None])) for i in range(n)]
    return rows + [(3, rows[3][1], "s"), (3, rows[4][1], "t"), rows[7], rows[7], (None, rows[8][1], "s"), (None, rows[8][1], "s"), (n, None, None), (n + 1, "w " * 30_000, "s")]


def test_against_brute_force(spark):
    for seed, hot in ((1, 1_000), (2, 5)):
        rows = made(150, seed)
        labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(3, 0, None), (None, 1, 1), (6, None, 1)]
        df = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, source string, bits int, Text string").repartition(6)
        lf = spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, part string")
        before, A.HOT = A.HOT, hot
        try:
            got = [tuple(r) for r in A.audit_filters(df, lf).collect()]
        finally:
            A.HOT = before
        assert len(got) == 3 * 600 and set(got) == brute(rows, labels)


def test_edges(spark):
    docs, labels = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    assert A.audit_filters(spark.createDataFrame([], docs), none).count() == 0
    rows = [(1, None, None)]
    assert {tuple(r) for r in A.audit_filters(spark.createDataFrame(rows, docs), none).collect()} == brute(rows, [])


def test_sieve_loses_no_key(spark):
    keys = spark.range(0, 3000, 3).toDF("k")
    rows = spark.range(0, 6000).withColumnRenamed("id", "k").withColumn("word", F.lit(1))
    for bits in (64, 1 << 10, 1 << 26):
        got = {r.k for r in passing(rows, F.col("k"), sieve(keys, "k", bits), bits).collect()}
        assert got >= set(range(0, 3000, 3)) and (bits < 1 << 26 or len(got) < 1_010)
    assert passing(rows, F.col("k"), sieve(keys.limit(0), "k")).count() == 0
