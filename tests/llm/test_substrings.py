import hashlib
import random

from tabwise.llm import substrings as S


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    owner = {}
    for i, w in split:
        if i is not None:
            for j in range(len(w) - 12):
                k = tuple(w[j:j + 13])
                owner[k] = min(owner.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and owner[tuple(w[j:j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    words = ["a", "b", "the", "of", "é", "x.", "word"] + ["v%d" % i for i in range(60)]
    passages = [r.choices(words, k=r.randint(10, 40)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.5 else r.choices(words, k=r.randint(1, 30))
        rows.append((i * 13 % 997, r.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_against_brute_force(spark):
    rows = made(150, 5) + [(5000, None), (5001, ""), (5002, "a " * 30_000), (5003, "a " * 13), (5004, "a " * 12), (None, "a " * 20), (4999, "a " * 14)]
    rows += [(13, rows[4][1] + " more"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for shard_bytes in (100_000_000, 2_000):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in S.remove_repeats(df, shard_bytes=shard_bytes).collect())
        assert got == brute(rows)


def test_small_batches_change_nothing(spark):
    rows = made(120, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in S.remove_repeats(df, shard_bytes=3_000).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(rows)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, shard int, z int")
    assert S.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(1, "q " * 15, 1, 2), (2, "q " * 15, None, None)], "doc_id long, text string, shard int, Doc_ID int")
    assert sorted(r.n_removed for r in S.remove_repeats(df).collect()) == [0, 15]


def test_nothing_is_removed_without_the_automaton(spark, monkeypatch):
    rows = made(40, 3)
    docs = S.pa.table({"doc": S.pa.array([i for i, _ in rows]), "z": S.pa.array([S.zstandard.ZstdCompressor().compress(t.encode()) for _, t in rows])})
    owners = {}
    for i, t in sorted(rows):
        w = t.split()
        for j in range(len(w) - 12):
            owners.setdefault(tuple(w[j:j + 13]), i)
    found = S.pa.table({"owner": S.pa.array(list(owners.values())), "passage": S.pa.array([" ".join(k) for k in owners])})
    want = {i: gone for i, _, gone, _, _ in brute(rows)}
    got = S._remove(docs, found, False)
    assert dict(zip(got["doc_id"].to_pylist(), got["n_removed"].to_pylist())) == want and sum(want.values()) > 100
    empty = S.ahocorasick.Automaton(S.ahocorasick.STORE_LENGTH)
    empty.add_word("\x00")
    empty.make_automaton()
    real = S.automaton
    monkeypatch.setattr(S, "automaton", lambda phrases, distinct: (empty, real(phrases, distinct)[1]))
    assert sum(S._remove(docs, found, False)["n_removed"].to_pylist()) == 0


def test_equal_hashes_are_compared_by_their_words(monkeypatch):
    import numpy as np

    rows = [(1, " ".join("a%d" % i for i in range(13))), (2, " ".join("b%d" % i for i in range(13)))]
    docs = S.pa.table({"doc": S.pa.array([2]), "z": S.pa.array([S.zstandard.ZstdCompressor().compress(rows[1][1].encode())])})
    real = S.rolling
    monkeypatch.setattr(S, "rolling", lambda a, n, odd: real(a, n, odd) * np.uint64(n != S.WINDOW))  # all windows' hashes alike
    got = S._remove(docs, S.pa.table({"owner": S.pa.array([1, 1]), "passage": S.pa.array([rows[0][1], rows[1][1]])}), False)
    assert got["n_removed"].to_pylist() == [13]
    got = S._remove(docs, S.pa.table({"owner": S.pa.array([1]), "passage": S.pa.array([rows[0][1]])}), False)
    assert got["n_removed"].to_pylist() == [0]
