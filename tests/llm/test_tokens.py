import random

from tabwise.llm import tokens as K


def brute(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        own = first if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return 1, 1
        n, at = n + 1, end
    return n, 0


def test_automaton_against_greedy_cuts():
    r = random.Random(4)
    for _ in range(60):
        pieces = {bytes(r.choices(b"abc", k=r.randint(1, 5))) for _ in range(r.randint(1, 25))}
        first, rest = {p for p in pieces if r.random() < 0.6}, {p for p in pieces if r.random() < 0.6}
        auto = K.Automaton(first, rest)
        for _ in range(60):
            w = bytes(r.choices(b"abcd" if r.random() < 0.2 else b"abc", k=r.randint(1, 12)))
            assert auto.count(w) == brute(w, first, rest), (w, first, rest)


PIECES = [bytes([b]) for b in range(256)] + [b" the", b" th", b"ing", b"in", b"\xc3\xa9", b" ab", b"abc", b"bcd"]


def test_rows(spark):
    rows = [(1, "the thing in"), (1, "the thing in"), (2, None), (3, " \n"), (4, "é éé"), (None, "abcd"), (5, "thing " * 20_000), (6, "x" * 300)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_words int, Doc_ID string")
    first, rest = {p for p in PIECES if p[:1] == b" "}, {p for p in PIECES if p[:1] != b" "}

    def want(i, t):
        cuts = [brute(b" " + w, first, rest)[0] for w in (t or "").encode().split()]
        return i or -1, len(cuts), sum(cuts), 0, max(cuts, default=0), len(t or "")

    got = sorted((r.doc_id or -1, *tuple(r)[1:]) for r in K.count_tokens(df, PIECES).collect())
    assert got == sorted(want(*r) for r in rows)
    assert K.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_unknown_words(spark):
    df = spark.createDataFrame([(1, "ab ba q")], "doc_id long, text string")
    assert tuple(K.count_tokens(df, [b" ", b" a", b"b"]).first())[1:5] == (3, 4, 2, 2)
