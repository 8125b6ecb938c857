import random
import zlib

import numpy as np

from tabwise.llm import toxicity as X


def corpus(n, seed):
    r = random.Random(seed)
    plain = ["the", "of", "and"] + ["".join(r.choices("abdefgh", k=r.randint(2, 8))) for _ in range(400)]
    bad = ["zork" + e for e in ("a", "en", "ist", "ung", "el", "ich")] + ["vexil"]
    out = []
    for i in range(n):
        w = r.choices(plain, k=r.randint(5, 200))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    h = X.HIDDEN
    p = {"Uf": rng.standard_normal((h, 3 * h)), "Ub": rng.standard_normal((h, 3 * h)), "v": rng.standard_normal(2 * h), "w": rng.standard_normal(2 * h), "b": np.zeros(1)}
    proj, mask, d = rng.standard_normal((3, 5, 6 * h)), np.arange(5)[None] < np.array([[5], [3], [0]]), np.array([1.0, -2.0, 0.5])
    _, state = X._forward(p, proj, mask, keep=True)
    back = np.zeros_like(proj)
    g = X._backward(p, state, mask, d, back)

    def loss():
        return float((X._forward(p, proj, mask)[0] * d).sum())

    for name, at in (("Uf", (1, 2)), ("Ub", (3, 17)), ("Uf", (0, 20)), ("v", (4,)), ("w", (9,))):
        old = p[name][at]
        p[name][at] = old + 1e-2
        hi = loss()
        p[name][at] = old - 1e-2
        lo = loss()
        p[name][at] = old
        assert abs((hi - lo) / 2e-2 - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_held_out_accuracy_and_order():
    rows = corpus(700, 1)
    model = X.train([t for _, t, _ in rows[:500]], [y for _, _, y in rows[:500]])
    z = X.text_logits(model, [X.WORD.findall(t.encode()) for _, t, _ in rows[500:]])
    y = np.array([l for _, _, l in rows[500:]])
    hit = model.score(z) >= X.CUT
    assert (hit == (y == 1)).mean() > 0.9
    again = X.train([t for _, t, _ in rows[:500]], [y for _, _, y in rows[:500]])
    assert np.allclose(model.score(z), again.score(z))


def test_all_windows_are_seen():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        w = X.cut_windows(np.arange(n, dtype=np.int32))
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == X.WINDOW


def test_rows(spark):
    rows = corpus(400, 3)
    extra = [(1000, None), (1001, ""), (1002, "!!! ???"), (None, "zorka"), (1003, "the " * 40_000 + "zorkung vexil zorkist"), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(i, t, None, None) for i, t in extra], "doc_id long, text string, Toxic string, score double").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, None, None), (3, 1, None)], "doc_id long, quality long, toxic long")
    out = X.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    truth = {i: y for i, _, y in rows}
    aside = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in aside]) > 0.9
    assert len({r.score for r in out if r.doc_id in (1000, 1001, 1002)}) == 1
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic long")
    assert [r.score for r in X.score_toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert X.score_toxicity(docs.limit(0), labels).count() == 0 and X.drop_toxic(docs, labels).count() == 2


def test_pieces_hold_every_byte_and_gram():
    for n in [*range(1, 130), 1000]:
        run = bytes(33 + (i * i + i // 7) % 90 for i in range(n))
        got = X.pieces([b"ab", run])[1:]
        at = [0] if n <= X.WORD_BYTES else list(range(0, n - X.PIECE + X.STEP, X.STEP))
        size = n if n <= X.WORD_BYTES else X.PIECE
        assert got == [run[a:a + size] for a in at] and X.pieces(got) == got
        assert {a + j for a, g in zip(at, got) for j in range(len(g))} == set(range(n))
        inner = {a + j for a, g in zip(at, got) for j in range(1, len(g) - 3)}
        assert inner == set(range(1, n - 3))


def unspaced(n, seed, letters, bad):
    """One run of letters a text; in every third, toxic letters stand somewhere behind byte 24."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        run = "".join(r.choices(letters, k=r.randint(40, 160)))
        at = r.randint(24, len(run))
        out.append((run[:at] + r.choice(bad) + run[at:] if i % 3 == 0 else run, int(i % 3 == 0)))
    return out


def test_toxic_piece_behind_byte_24_of_an_unspaced_run():
    for letters, bad in (("abdefgh", ["zorkung", "vexilzork"]), ("人大天日月水火木", ["死鬼毒苦"])):
        rows = unspaced(450, 7, letters, bad)
        model = X.train([t for t, _ in rows[:330]], [y for _, y in rows[:330]])
        hit = model.score(X.text_logits(model, [X.WORD.findall(t.encode()) for t, _ in rows[330:]])) >= X.CUT
        assert (hit == np.array([y == 1 for _, y in rows[330:]])).mean() > 0.9
