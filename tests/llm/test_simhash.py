import random

import xxhash

from tabwise.llm import simhash as H
from tabwise.llm.components import components


def brute(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    return fps, groups(fps, [i for i, _ in rows])


def groups(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        known = [y for y in (least.get(r), x) if y is not None]
        least[r] = min(known, default=None)
    return [least[find(i)] for i in range(len(fps))]


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choices(words, k=r.randint(60, 200))))
    return out


def test_against_brute_force(spark):
    rows = [(i * 7 % 301, t) for i, t in enumerate(texts(300))]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "Two  Words"), (None, rows[0][1]), (3, "one"), (907, "é ü x y")]
    rows += [(1000, "long " * 30_000)]
    fps, comp = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in H.near_duplicates(df).collect())
    assert got == sorted((i or -1, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp))


def test_crowded_keys_lose_no_link(spark):
    """The same components whether a key's members are compared in one task or go through neighbour keys."""
    r = random.Random(3)
    fps = set()
    while len(fps) < 150:
        base = r.choice([0, 1 << 63, 0xF0F0]) if len(fps) % 2 else r.choice(sorted(fps) or [0])
        for _ in range(r.randint(0, 4)):
            base ^= 1 << r.randrange(64)
        fps.add(base)
    fps = sorted(fps)
    df = spark.createDataFrame([(H.signed(x),) for x in fps], "fp long")
    want = groups(fps, list(range(len(fps))))
    for crowd in (20_000, 4, 1):
        got = {x.node: x.root for x in components(H.near_links(df, crowd)).collect()}
        root = [got.get(H.signed(x), H.signed(x)) for x in fps]
        assert all((root[i] == root[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i)), crowd


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, Text string, fp int, a int")
    assert H.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "x", None, None), (2, "A B C d", "y", 3, 4)], "doc_id long, text string, Text string, fp int, component_id int")
    assert [r.component_id for r in H.near_duplicates(df).collect()] == [1, 1]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 81
