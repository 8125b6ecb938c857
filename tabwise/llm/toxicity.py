"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters by a word part and a character part (its prefixes and inner four-byte grams), both
hashed to buckets with an evidence weight and a learned vector.  A run too long for one word, as in
scripts without spaces, is cut into overlapping pieces, each a word of its own.  The network reads overlapping windows
of words in both directions, attention pools each window, and a text scores as its highest window.
It is fitted on a bounded sample of labelled rows; scoring covers every window of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, pick, ship

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 16
#: Most bytes of a word.
WORD_BYTES = 24
#: A longer run becomes pieces of so many bytes, one from each STEP bytes on (three letters at every letter in most scripts without spaces).
PIECE, STEP = 9, 3
HIDDEN, EMBED = 8, 4
#: The fit uses at most so many labelled rows of either label, none longer than the bytes stated.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 2_500, 3_500, 20_000
#: Share of the sample that sets the threshold.
VALID = 0.25
#: A text counts as toxic from this score on; the threshold found on the validation rows is put here.
CUT = 0.7
#: Words whose inputs a task remembers.
REMEMBERED = 400_000


def pieces(runs: list[bytes]) -> list[bytes]:
    """Words of runs of letters: a run itself, or its overlapping pieces if it is longer than WORD_BYTES."""
    if not runs or max(map(len, runs)) <= WORD_BYTES:
        return runs
    out = []
    for run in runs:
        out += [run] if len(run) <= WORD_BYTES else [run[at:at + PIECE] for at in range(0, len(run) - PIECE + STEP, STEP)]
    return out


def _words(text: str | None) -> list[bytes]:
    return pieces(WORD.findall((text or "").encode().lower()))


def word_features(words: list[bytes], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Word bucket (n) and character buckets (n, k) of words; -1 where a word has no such gram."""
    parts = [_word_features(words[at:at + at_once]) for at in range(0, max(1, len(words)), at_once)]
    width = max(c.shape[1] for _, c in parts)
    out = np.full((len(words), width), -1, np.int32)
    at = 0
    for _, c in parts:
        out[at:at + len(c), :c.shape[1]] = c
        at += len(c)
    return np.concatenate([w for w, _ in parts]), out


def _word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    raw = np.frombuffer(b"".join(w[:WORD_BYTES].ljust(WORD_BYTES, b"\0") for w in words), np.uint8).reshape(n, WORD_BYTES).astype(np.uint64) if n else np.zeros((0, WORD_BYTES), np.uint64)
    length = np.fromiter((min(len(w), WORD_BYTES) for w in words), np.int64, n)
    odd = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WORD_BYTES + 1)], np.uint64)

    def bucket(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32) % BUCKETS

    whole = (raw * odd[:WORD_BYTES]).sum(1, dtype=np.uint64) + length.astype(np.uint64) * odd[WORD_BYTES]
    grams = []
    for k in (3, 4, 5, 6):
        grams.append(np.where(length >= k, bucket((raw[:, :k] * odd[:k]).sum(1, dtype=np.uint64) + np.uint64(k)), -1))
    for j in range(1, WORD_BYTES - 3):
        h = raw[:, j] * odd[0] + raw[:, j + 1] * odd[1] + raw[:, j + 2] * odd[2] + raw[:, j + 3] * odd[3] + np.uint64(99)
        g = np.where(length >= j + 4, bucket(h), -1)
        if not (g >= 0).any():
            break
        grams.append(g)
    return bucket(whole), np.stack(grams, 1) if n else np.zeros((0, 4), np.int32)


class _Evidence:
    """Counts of buckets in toxic and clean texts, and the log odds they give, shrunk where few texts speak."""

    def __init__(self, found: list[tuple[np.ndarray, int]]):
        self.pos, self.neg, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS), [0, 0]
        for buckets, label in found:
            (self.pos if label else self.neg)[buckets] += 1
            self.n[label] += 1

    def of(self, buckets: np.ndarray | slice = slice(None), without: int | None = None) -> np.ndarray:
        """Evidence of buckets; ``without`` is the label of a counted text that is left out."""
        pos, neg = np.maximum(self.pos[buckets] - (without == 1), 0), np.maximum(self.neg[buckets] - (without == 0), 0)
        p, q = (pos + 0.5) / (self.n[1] + 1), (neg + 0.5) / (self.n[0] + 1)
        lo = np.log(p / q)
        seen = np.where(lo > 0, pos, neg)
        return np.clip(lo * seen / (seen + 4), -4, 8).astype(np.float32) / 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights; ``word_lo`` and ``char_lo`` are evidence tables, the rest is learned."""

    p: dict[str, np.ndarray]
    word_lo: np.ndarray
    char_lo: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        wb, cb = word_features(words)
        return _inputs(self.p, wb, cb, self.word_lo, self.char_lo)

    def project(self, words: list[bytes]) -> np.ndarray:
        x = self.inputs(words)
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1).astype(np.float32)

    def windows(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logit of each window (rows of word numbers, -1 for none); the last row of ``projected`` is for none."""
        return _forward(self.p, projected[ids], ids >= 0)[0]

    def score(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logit + self.shift)


def _inputs(p, wb, cb, word_lo, char_lo):
    has = cb >= 0
    safe = np.where(has, cb, 0)
    lo = np.where(has, char_lo[safe], -9)
    top = np.where(has.any(1), lo.max(1), 0)
    return np.concatenate([word_lo[wb][:, None], top[:, None], _embedded(p, wb, cb)], 1).astype(np.float32)


def _embedded(p, wb, cb):
    """Learned vectors: of the word, and the mean of those of its grams (the last axis of cb)."""
    has = cb >= 0
    mean = (p["Ec"][np.where(has, cb, 0)] * has[..., None]).sum(-2) / np.maximum(has.sum(-1), 1)[..., None]
    return np.concatenate([p["Ew"][wb], mean], -1).astype(np.float32)


def _gru(proj, U, back, mask, keep):
    """States (T, B, H) of one direction; with ``keep`` also what the backward pass needs."""
    steps, size, h3 = proj.shape[1], proj.shape[0], proj.shape[2]
    n = h3 // 3
    h = np.zeros((size, n), np.float32)
    out, kept = np.zeros((steps, size, n), np.float32), []
    for t in (range(steps - 1, -1, -1) if back else range(steps)):
        a, u = proj[:, t], h @ U
        rz = 1 / (1 + np.exp(-np.clip(a[:, :2 * n] + u[:, :2 * n], -30, 30)))
        r, z = rz[:, :n], rz[:, n:]
        c = np.tanh(a[:, 2 * n:] + r * u[:, 2 * n:])
        z = z * mask[:, t, None]
        new = h + z * (c - h)
        if keep:
            kept.append((t, h, r, z, rz[:, n:], c, u[:, 2 * n:]))
        h = new
        out[t] = h
    return out, kept


def _forward(p, proj, mask, keep=False):
    n3 = 3 * HIDDEN
    m = mask.astype(np.float32)
    f, kf = _gru(proj[:, :, :n3], p["Uf"], False, m, keep)
    b, kb = _gru(proj[:, :, n3:], p["Ub"], True, m, keep)
    h = np.concatenate([f, b], 2)
    e = h @ p["v"] + np.where(mask.T, 0, -1e9).astype(np.float32)
    e = np.exp(e - e.max(0))
    a = e * mask.T
    a = a / np.maximum(a.sum(0), 1e-9)
    c = (a[:, :, None] * h).sum(0)
    return c @ p["w"] + p["b"][0], (h, a, c, kf, kb)


def _gru_back(kept, U, dH, dproj):
    """Adds the gradient of the inputs to ``dproj`` and returns that of U."""
    n = HIDDEN
    dU = np.zeros_like(U)
    dh = np.zeros(dH.shape[1:], np.float32)
    for t, h, r, z, z0, c, u in reversed(kept):
        dh = dh + dH[t]
        dc = dh * z * (1 - c * c)
        masked = np.where(z0 > 0, z / np.maximum(z0, 1e-20), 0)
        dz = dh * (c - h) * masked * z0 * (1 - z0)
        dr = dc * u * r * (1 - r)
        da = np.concatenate([dr, dz, dc], 1)
        du = np.concatenate([dr, dz, dc * r], 1)
        dproj[:, t] += da
        dU += h.T @ du
        dh = dh * (1 - z) + du @ U.T
    return dU


def _backward(p, state, mask, dlogit, dproj):
    h, a, c, kf, kb = state
    n, n3 = HIDDEN, 3 * HIDDEN
    g = {"w": c.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
    dc = dlogit[:, None] * p["w"]
    da = (h * dc).sum(2)
    de = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tbh,tb->h", h, de)
    dH = a[:, :, None] * dc + de[:, :, None] * p["v"]
    g["Uf"] = _gru_back(kf, p["Uf"], dH[:, :, :n], dproj[:, :, :n3])
    g["Ub"] = _gru_back(kb, p["Ub"], dH[:, :, n:], dproj[:, :, n3:])
    return g


def _starts(n: int) -> range:
    return range(0, max(1, n - STRIDE), STRIDE)


def cut_windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text's word numbers, padded with -1."""
    starts = _starts(len(ids))
    padded = np.full(starts[-1] + WINDOW, -1, np.int32)
    padded[:min(len(ids), len(padded))] = ids[:len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def train(texts: list[str | None], labels: list[int], seed: int = 5, epochs: int = 7) -> Model | None:
    """Fit on texts with labels 0 and 1; None if a label is missing.  The same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in _words(t)), np.int32) for t in texts]
    y = np.array(labels)
    if len(set(labels)) < 2 or min(np.bincount(y, minlength=2)) < 4:
        return None
    wb, cb = word_features(list(vocab))
    wb, cb = np.r_[wb, 0], np.concatenate([cb, np.full((1, cb.shape[1]), -1, cb.dtype)])
    # with many toxic rows some of either label set the threshold; with few all do, each judged without itself
    aside = np.zeros(len(y), bool)
    if y.sum() >= 200:
        order = rng.permutation(len(y))
        for label in (0, 1):
            own = order[y[order] == label]
            aside[own[:int(len(own) * VALID)]] = True
    use = np.flatnonzero(~aside)
    uniques = [np.unique(i) for i in ids]
    word_ev = _Evidence([(np.unique(wb[uniques[i]]), int(y[i])) for i in use])
    char_ev = _Evidence([((lambda g: g[g >= 0])(np.unique(cb[uniques[i]])), int(y[i])) for i in use])

    def evidence(i: int) -> np.ndarray:
        """Word and character evidence of each word of a text, the text itself left out."""
        u, back = np.unique(ids[i], return_inverse=True)
        without = None if aside[i] else int(y[i])
        lo = np.where(cb[u] >= 0, char_ev.of(np.maximum(cb[u], 0), without), -9).max(1)
        return np.stack([word_ev.of(wb[u], without), np.where((cb[u] >= 0).any(1), lo, 0)], 1)[back].astype(np.float32)

    def in_windows(i: int) -> tuple[np.ndarray, np.ndarray]:
        w = cut_windows(ids[i])
        place = cut_windows(np.arange(len(ids[i]), dtype=np.int32))
        lo = evidence(i) if len(ids[i]) else np.zeros((1, 2), np.float32)
        return w, np.where((w >= 0)[:, :, None], lo[np.maximum(place, 0)], 0)

    def r(*shape, s=0.3):
        return (rng.standard_normal(shape) * s).astype(np.float32)

    dim = 2 + 2 * EMBED
    p = {"Ew": r(BUCKETS, EMBED, s=0.05), "Ec": r(BUCKETS, EMBED, s=0.05), "Wf": r(dim, 3 * HIDDEN), "Wb": r(dim, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
         "Uf": r(HIDDEN, 3 * HIDDEN), "Ub": r(HIDDEN, 3 * HIDDEN), "v": r(2 * HIDDEN), "w": r(2 * HIDDEN), "b": np.array([-1.0], np.float32)}
    # a toxic text lends its strongest window, a clean one its strongest and two others
    picked, strength, target = [], [], []
    for i in use:
        w, lo = in_windows(i)
        power = np.where(w >= 0, lo[:, :, 0] + np.maximum(lo[:, :, 1], 0), -9).max(1)
        take = {int(power.argmax())} if y[i] else {int(power.argmax()), *rng.integers(0, len(w), 2).tolist()}
        for k in sorted(take):
            picked.append(w[k])
            strength.append(lo[k])
            target.append(y[i])
    win, los, target = np.array(picked), np.array(strength), np.array(target, np.float32)
    weight = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    size = 256 if len(win) > 4_000 else 64
    total = max(epochs * -(-len(win) // size), 300)
    step = 0
    while step < total:
        own = rng.permutation(len(win))
        for at in range(0, len(own), size):
            b = own[at:at + size]
            step += 1
            u, inv = np.unique(win[b], return_inverse=True)
            inv = inv.reshape(win[b].shape)
            mask = win[b] >= 0
            x = np.concatenate([los[b], _embedded(p, wb[u], cb[u])[inv]], 2)
            proj = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 2)
            logit, state = _forward(p, proj, mask, keep=True)
            d = ((sigmoid(logit) - target[b]) * weight[b] / len(b)).astype(np.float32)
            dproj = np.zeros_like(proj)
            g = _backward(p, state, mask, d, dproj)
            dproj *= mask[:, :, None]
            df, db = dproj[:, :, :3 * HIDDEN], dproj[:, :, 3 * HIDDEN:]
            g |= {"Wf": np.tensordot(x, df, ([0, 1], [0, 1])), "Wb": np.tensordot(x, db, ([0, 1], [0, 1])), "bf": df.sum((0, 1)), "bb": db.sum((0, 1))}
            dx = (df @ p["Wf"].T + db @ p["Wb"].T)[:, :, 2:]
            flat = np.zeros((len(u), 2 * EMBED), np.float32)
            np.add.at(flat, inv, dx)
            g["Ew"], g["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
            np.add.at(g["Ew"], wb[u], flat[:, :EMBED])
            has = cb[u] >= 0
            share = (flat[:, None, EMBED:] / np.maximum(has.sum(1), 1)[:, None, None]) * has[:, :, None]
            np.add.at(g["Ec"], np.where(has, cb[u], 0), share)
            rate = 0.01 * (1 - step / (total + 1))
            for name, grad in g.items():
                rows = np.unique(wb[u]) if name == "Ew" else np.unique(cb[u][has]) if name == "Ec" else slice(None)
                decay = 1e-2 if name in ("Ew", "Ec") else 1e-4
                gr = grad[rows] + decay * p[name][rows] / len(b)
                m1[name][rows] = 0.9 * m1[name][rows] + 0.1 * gr
                m2[name][rows] = 0.99 * m2[name][rows] + 0.01 * gr * gr
                p[name][rows] -= rate * m1[name][rows] / (np.sqrt(m2[name][rows]) + 1e-6)
    model = Model(p, word_ev.of(), char_ev.of())
    valid = np.flatnonzero(aside) if aside.any() else np.arange(len(y))
    z = np.empty(len(valid))
    for k, i in enumerate(valid):
        w, lo = in_windows(i)
        x = np.concatenate([lo, _embedded(p, wb[w], cb[w])], 2) if not (w < 0).all() else np.zeros((len(w), WINDOW, 2 + 2 * EMBED), np.float32)
        proj = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 2)
        z[k] = _forward(p, proj, w >= 0)[0].max()
    model.scale, model.shift = _calibrate(z, y[valid])
    return model


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift so that scores follow the labels' odds and the best threshold for F1 sits at CUT."""
    a, b, t = 1.0, 0.0, (y * (y.sum() + 1) + (1 - y)) / np.where(y > 0, y.sum() + 2, (1 - y).sum() + 2)
    for _ in range(300):
        e = sigmoid(a * z + b) - t
        a, b = max(0.05, a - 0.05 * float((e * z).mean() + 0.01 * (a - 1))), b - 0.05 * float(e.mean())
    cuts = np.unique(z)
    best, at = -1.0, 0.0
    for lo, hi in zip(np.r_[cuts[0] - 1, cuts[:-1]], cuts):
        hit = z >= hi
        f1 = 2 * (hit & (y > 0)).sum() / max(1, hit.sum() + y.sum())
        if f1 > best:
            best, at = f1, (lo + hi) / 2
    return a, float(np.log(CUT / (1 - CUT)) - a * at)


def text_logits(model: Model, texts: list[list[bytes]]) -> np.ndarray:
    """Highest window logit of each text."""
    return _Scorer(model)([pieces(t) for t in texts])


class _Scorer:
    """Scores texts in one task; inputs of words are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[list[bytes]]) -> np.ndarray:
        ids, known = self.ids, len(self.ids)
        if known > REMEMBERED:
            self.forget()
            ids, known = self.ids, 0
        rows, owner = [], []
        for k, words in enumerate(texts):
            w = cut_windows(np.array([ids.setdefault(x, len(ids)) for x in words], np.int32))
            rows.append(w)
            owner.append(np.full(len(w), k))
        if len(ids) > known:
            new = list(ids)[known:]
            fresh = [self.model.project(new[at:at + 20_000]) for at in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table[:-1], *fresh, np.zeros((1, 6 * HIDDEN), np.float32)])
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        logit = np.concatenate([self.model.windows(self.table, rows[at:at + 1024]) for at in range(0, len(rows), 1024)])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        return best


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list:
    """(text, label) of the labelled rows used for the fit: of those not held out, a bounded number of either label by hash order."""
    known = pick(labels, id_col, label_col).toDF("doc_id", "label").filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    sample = known.filter("label = 1").orderBy("h", "doc_id").limit(FIT_TOXIC).union(known.filter("label = 0").orderBy("h", "doc_id").limit(FIT_CLEAN))
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").filter(F.octet_length("text") <= FIT_BYTES)
    # FIT_TOXIC + FIT_CLEAN ids are sent at most, and as many rows come back, also where an id has very many
    rows = d.join(F.broadcast(sample), "doc_id").orderBy("h", "doc_id", "text").limit(FIT_TOXIC + FIT_CLEAN).select("doc_id", "text", "label").collect()
    return [(r.text, int(r.label)) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    rows = fit_sample(docs, labels, id_col, text_col, label_col)
    return train([t for t, _ in rows], [l for _, l in rows])


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that score below the cut, with all of their columns; all of them if there is nothing to learn from."""
    model = fit(docs, labels, id_col, text_col, label_col)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value
        scorer = _Scorer(m)
        return lambda texts: [bool(s < CUT) for s in m.score(scorer([_words(t) for t in texts]))]

    return keep_rows(docs, text_col, start)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """One row per document: held_out, score (0 to 1), predicted (1 from 0.7 on).

    Null and wordless texts score as an empty window.  Without four labelled rows of either label all
    scores are zero.  Repeated rows give repeated results, an empty table an empty one; a null
    doc_id is not held out; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    model = model or fit(docs, labels, id_col, text_col, label_col)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = _Scorer(m) if m else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                score = m.score(scorer([_words(t) for t in texts])) if m else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(float))], ["doc_id", "score"])

    scored = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
