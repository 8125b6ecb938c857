"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its context.

Candidates are long runs of key characters with a digit, separators or mixed case.  The network sees a candidate's characters and
what stands before and after it.  It is fitted on the candidates of a bounded sample of rows, labelled by
the fixed patterns, with random keys of other alphabets put in the same places; its probabilities are
calibrated, and the threshold is the highest that keeps the wanted recall of the findings of all rows kept out of the fit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, pick, replace_text, ship

#: Patterns of keys in texts; a match that is too short is dropped.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{10,}")
BEFORE, INSIDE, AFTER = 24, 40, 8
#: Rows of the sample the network is fitted on, none longer than the bytes stated.
FIT_ROWS, FIT_BYTES = 12_000, 20_000
#: Part of the labelled findings that the threshold must keep.
RECALL = 0.98
EMBED, FILTERS, WIDTH, LETTERS = 8, 24, 5, 98


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind number, start of the value) of the fixed patterns, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if _key_like(m.group())]


def _key_like(run: str) -> bool:
    """A letter or digit is there, and letters alone change case after the first."""
    return not (run[1:].islower() or run[1:].isupper()) if run.isalpha() else any(c.isalnum() for c in run)


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Views of a candidate (rows of letter numbers); one longer than INSIDE gives overlapping views, the last at its end."""
    places = [start] if end - start <= INSIDE else [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    out = np.zeros((len(places), BEFORE + INSIDE + AFTER), np.uint8)
    for row, at in zip(out, places):
        stop = min(at + INSIDE, end)
        for piece, left in ((text[max(0, at - BEFORE):at].rjust(BEFORE, "\0"), 0), (text[at:stop], BEFORE), (text[stop:stop + AFTER], BEFORE + INSIDE)):
            codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
            row[left:left + len(codes)] = np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 30, 1))
    return out


@dataclass
class Network:
    """Embedding, one convolution, pooling over candidate and context, one output; then scale, shift and threshold."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_forward(self.p, x[at:at + 512])[0] for at in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def _forward(p, x):
    e = p["E"][x]
    m = x.shape[1] - WIDTH + 1
    cols = np.concatenate([e[:, j:j + m] for j in range(WIDTH)], 2)
    a = cols @ p["C"] + p["c"]
    inside = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
    in_at, out_mask = a[:, inside].argmax(1), a.copy()
    out_mask[:, inside] = -np.inf
    ctx_at = out_mask.argmax(1)
    rows = np.arange(len(x))[:, None]
    f = np.arange(FILTERS)[None]
    present = (x[:, BEFORE:BEFORE + INSIDE] > 0).sum(1, keepdims=True)
    mean = np.maximum(a[:, inside], 0).sum(1) / np.maximum(present, 1)
    pooled = np.concatenate([np.maximum(a[rows, in_at + BEFORE, f], 0), np.maximum(a[rows, ctx_at, f], 0), mean, present / INSIDE], 1)
    return pooled @ p["w"] + p["b"][0], (cols, a, in_at + BEFORE, ctx_at, pooled, present)


def _step(p, x, y, weight):
    """Gradients of the weighted log loss."""
    logit, (cols, a, in_at, ctx_at, pooled, present) = _forward(p, x)
    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()])}
    dp = d[:, None] * p["w"]
    da = np.zeros_like(a)
    rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
    inside = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
    da[:, inside] += ((a[:, inside] > 0) * (dp[:, 2 * FILTERS:3 * FILTERS] / np.maximum(present, 1))[:, None, :])
    np.add.at(da, (rows, in_at, f), dp[:, :FILTERS] * (pooled[:, :FILTERS] > 0))
    np.add.at(da, (rows, ctx_at, f), dp[:, FILTERS:2 * FILTERS] * (pooled[:, FILTERS:2 * FILTERS] > 0))
    g["C"] = np.tensordot(cols, da, ([0, 1], [0, 1]))
    g["c"] = da.sum((0, 1))
    dcols = da @ p["C"].T
    g["E"] = np.zeros_like(p["E"])
    m = a.shape[1]
    for j in range(WIDTH):
        np.add.at(g["E"], x[:, j:j + m], dcols[:, :, j * EMBED:(j + 1) * EMBED])
    return g


def _invented(rng: np.random.Generator) -> str:
    """A random key of another alphabet than the labelled ones."""
    alphabet = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEF0123456789"][rng.integers(4)]
    key = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(20, 44)))
    return ["", "", "sk_live_", "ghp_", "xoxb-"][rng.integers(5)] + key


def train(findings: list[tuple[str, int, int, int]], seed: int = 3, epochs: int = 8) -> Network | None:
    """Fit on (text around, start, end, label); None with fewer than ten findings of either label."""
    rng = np.random.default_rng(seed)
    views, y, group, key_of = [], [], [], []

    def add(text, start, end, label, number, invented=0):
        for v in encode(text, start, end):
            views.append(v)
            y.append(label)
            group.append(number)
            key_of.append(2 * number + invented)

    for number, (text, start, end, label) in enumerate(findings):
        add(text, start, end, label, number)
        if label:
            key = _invented(rng)
            add(text[:start] + key + text[end:], start, start + len(key), 1, number, 1)
    x, y, group = np.array(views), np.array(y, float), np.array(group)
    if len(y) == 0 or min((y > 0).sum(), (y == 0).sum()) < 10:
        return None
    aside = rng.random(group.max() + 1)[group] < 0.25
    if min((y[aside] > 0).sum(), (y[aside] == 0).sum()) < 5:
        aside[:] = False
    p = {"E": rng.standard_normal((LETTERS, EMBED)) * 0.3, "C": rng.standard_normal((WIDTH * EMBED, FILTERS)) * 0.15, "c": np.zeros(FILTERS), "w": rng.standard_normal(3 * FILTERS + 1) * 0.2, "b": np.zeros(1)}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    own = np.flatnonzero(~aside)
    weight = np.where(y > 0, 0.5 / y[own].mean(), 0.5 / (1 - y[own].mean()))
    step = 0
    for _ in range(max(epochs, -(-150 * 128 // len(own)))):
        for at in range(0, len(own), 128):
            if at == 0:
                order = rng.permutation(own)
            b = order[at:at + 128]
            step += 1
            for k, g in _step(p, x[b], y[b], weight[b]).items():
                g = g + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] = p[k] - 0.005 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    net = Network(p)
    check = np.flatnonzero(aside) if aside.any() else own
    z, t = net.logits(x[check]), y[check]
    t = (t * (t.sum() + 1) + (1 - t)) / np.where(t > 0, t.sum() + 2, (1 - t).sum() + 2)
    a, b = 1.0, 0.0
    for _ in range(400):
        e = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - t
        a, b = max(0.05, a - 0.05 * float((e * z).mean())), b - 0.1 * float(e.mean())
    net.scale, net.shift = a, b
    best: dict[int, float] = {}
    for i, probability in zip(check, net.probability(z)):
        if y[i] > 0:
            best[key_of[i]] = max(best.get(key_of[i], 0.0), float(probability))
    right = sorted(best.values(), reverse=True)
    net.threshold = right[max(0, int(np.ceil(RECALL * len(right))) - 1)]
    return net


def labelled(text: str) -> list[tuple[str, int, int, int]]:
    """A text's candidates with some text around each, labelled by the fixed patterns."""
    spans = [(v, e) for _, e, _, v in base_findings(text)]
    out = []
    for start, end in candidates(text):
        left = max(0, start - BEFORE)
        out.append((text[left:end + AFTER], start - left, end - left, int(any(a < end and start < b for a, b in spans))))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Fit on the rows that come first by a hash of their id, a quarter of all ids left out; all other rows set the threshold."""
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    some = d.filter("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 0").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    fitted = F.coalesce(F.col("sampled") & (F.octet_length("text") <= FIT_BYTES), F.lit(False))
    marked = d.join(F.broadcast(some.withColumn("sampled", F.lit(True))), "doc_id", "left")  # FIT_ROWS ids at most
    # FIT_ROWS rows at most, also where an id has very many
    d = marked.filter(fitted).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(FIT_ROWS).repartition(16, F.xxhash64("doc_id", "text"))

    def start():
        return lambda doc, text: ((doc, *x) for x in labelled(text or ""))

    rows = map_rows(d.select("doc_id", "text"), start, "doc_id long, around string, first int, last int, label int").collect()
    net = train([tuple(r)[1:] for r in sorted(rows)])
    if net is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score():
        model = sent.value

        def work(doc, text):
            if text and base_findings(text):
                for around, first, last, label in labelled(text):
                    if label:
                        z = model.scale * model.logits(encode(around, first, last)).max() + model.shift
                        yield (int(np.floor(1000 * np.clip(z, -30, 30))),)
        return work

    # counts of the findings' calibrated logits, at most 60,001 of them
    counts = sorted(map_rows(marked.filter(~fitted).select("doc_id", "text"), score, "z long").groupBy("z").count().collect(), reverse=True)
    kept, total = 0, sum(r["count"] for r in counts)
    for r in counts:
        kept += r["count"]
        if kept >= RECALL * total:
            net.threshold = float(1 / (1 + np.exp(-r["z"] / 1000)))
            break
    return net


def _clear(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap none of ``taken`` (sorted by start)."""
    ends, top = [], 0
    for _, b in taken:
        top = max(top, b)
        ends.append(top)
    starts = [a for a, _ in taken]
    out = []
    for a, b in spans:
        k = bisect_right(starts, b - 1)
        if k == 0 or ends[k - 1] <= a:
            out.append((a, b))
    return out


def scan(text: str, net: Network | None) -> list[dict]:
    """All findings of a text by start, then kind; learned ones never overlap those of the fixed patterns."""
    base = base_findings(text)
    found = [{"kind": KINDS[k], "start": s, "end": e, "value_start": v, "score": 1.0} for s, e, k, v in base]
    spans = _clear(candidates(text), [(s, e) for s, e, _, _ in base]) if net else []
    if spans:
        views = [encode(text, *c) for c in spans]
        p = net.probability(net.logits(np.concatenate(views)))
        at = 0
        for c, v in zip(spans, views):
            best = float(p[at:at + len(v)].max())
            at += len(v)
            if best >= net.threshold:
                found.append({"kind": KINDS[3], "start": c[0], "end": c[1], "value_start": c[0], "score": best})
    return sorted(found, key=lambda f: (f["start"], KINDS.index(f["kind"])))


def redact(text: str, findings: list[dict], mark: str = "[SECRET]") -> str:
    """The text with every finding's value replaced; overlapping values become one mark."""
    out, at = [], 0
    for a, b in sorted((f["value_start"], f["end"]) for f in findings):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


FINDINGS = "array<struct<kind:string,start:long,end:long,value_start:long,score:double>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None | str = "fit") -> DataFrame:
    """One row per document: findings (kind, start, end, value_start, score) and the redacted text.

    Places are code points, the end exclusive.  Null text has no finding and stays null.  Where a table
    has too few findings to learn from, only the fixed patterns count.  Repeated rows give repeated
    results, an empty table an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(fit(docs, id_col, text_col) if net == "fit" else net)

    def start():
        model = sent.value

        def work(doc, text):
            found = scan(text or "", model)
            yield doc, found, redact(text, found) if found else text
        return work

    return map_rows(pick(docs, id_col, text_col), start, f"doc_id long, findings {FINDINGS}, redacted string")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None | str = "fit") -> DataFrame:
    """All rows and columns, the values of all findings replaced by a mark."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col) if net == "fit" else net)

    def start():
        model = sent.value
        return lambda text: redact(text, scan(text, model))

    return replace_text(docs, text_col, start)
