"""Personal data: fixed patterns, and a skip-chain conditional random field over number-like tokens.

Tokens with a digit or an at sign are the field's nodes; other tokens are outside by rule.  Neighbours
share a potential, and so do distant tokens that are equal or have one form: all of a kind are tied to a
node of their own, so any two are two steps apart however many there are.  The weights are fitted by
pseudo-likelihood on a bounded sample labelled by the fixed patterns, half of the tokens without their own
features, so that agreement is what tells them.  Loopy message passing, until messages settle, then makes
the labels of a document agree; tokens that a fixed pattern has told are evidence.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, pick, ship

KINDS = ("email", "ip", "card", "phone")
#: Patterns of personal data; matches whose digits do not fit are dropped.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPACE = re.compile(r"[\x20\x09-\x0D]")
NODE = re.compile(r"[0-9@]")
LABELS = ("other", *KINDS)
FEATURES = 1 << 14
#: Rows of the sample the weights are fitted on, none longer than the bytes stated.
FIT_ROWS, FIT_BYTES = 12_000, 20_000
#: Message passing ends when no message changes by more than this, or, should it swing, after so many rounds.
SETTLED, MOST_ROUNDS = 1e-3, 500
#: Weight of a label that a fixed pattern has told.
EVIDENCE = 10.0
#: Least probability of an added span's tokens.
SURE = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns in code points, by kind and start."""
    found = []
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", pos)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens with an ASCII digit or an at sign: start and end."""
    out, at = [], 0
    while m := NODE.search(text, at):
        start = m.start()
        while start > at and not SPACE.match(text[start - 1]):
            start -= 1
        stop = SPACE.search(text, m.end())
        at = stop.start() if stop else len(text)
        out.append((start, at))
    return out


def form(token: str) -> str:
    return re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", token)))


def features(text: str, start: int, end: int) -> list[int]:
    token = text[start:end]
    core = token.strip(".,;:!?\"'")
    before, after = text[max(0, start - 24):start].split(), text[end:end + 24].split()
    digits = sum(c.isdigit() for c in core)
    names = ["bias", "form=" + form(core), f"digits={min(digits, 20)}", f"length={min(len(core), 24)}", "head=" + form(core[:3]), "tail=" + form(core[-3:]),
             "only=" + "".join(sorted(set(re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", core))))),
             "before=" + form(before[-1][-12:]) if before else "start", "after=" + form(after[0][:12]) if after else "stop"]
    parts = core.split(".")
    if len(parts) == 4 and all(x.isdecimal() for x in parts):
        names.append(f"quad={all(len(x) <= 3 and int(x) <= 255 for x in parts)}")
    if 16 <= len(core) <= 19 and core.isascii() and core.isdigit():
        names.append(f"luhn={luhn(core)}")
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def links(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, list[int]]]]:
    """Chain links of tokens that follow each other, and groups (0 equal, 1 of one form) of two or more distant tokens."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 2]
    found: dict[tuple[int, str], list[int]] = {}
    for i, (a, b) in enumerate(spans):
        core = text[a:b].strip(".,;:!?\"'")
        found.setdefault((0, core), []).append(i)
        if len(core) >= 6:
            found.setdefault((1, form(core)), []).append(i)
    return chain, [(kind, members) for (kind, _), members in found.items() if len(members) > 1]


@dataclass
class Field:
    """Weights of token features, of chain links (ordered) and of links to the nodes of equal (0) and like-formed (1) tokens."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, feats: list[list[int]], chain: list[tuple[int, int]], groups: list[tuple[int, list[int]]], told: list[int] | None = None) -> np.ndarray:
        """Probabilities of the tokens' labels by loopy sum-product with damping; ``told`` are labels known beforehand (0: none)."""
        n = len(feats)
        own = np.zeros((n + len(groups), len(LABELS)))
        own[:n] = [self.node[f].sum(0) for f in feats]
        for i, label in enumerate(told or ()):
            if label:
                own[i, label] += EVIDENCE
        edges = np.array(chain + [(i, n + g) for g, (_, members) in enumerate(groups) for i in members], np.int64).reshape(-1, 2)
        if not len(edges):
            return _normal(own)
        kinds = [kind for kind, members in groups for _ in members]
        # two steps lie between members: agreement is raised by what the step through their node takes away
        tied = self.skip + np.log(2) * np.eye(len(LABELS)) * self.skip.any(axis=(1, 2), keepdims=True)
        tied -= np.log(np.exp(tied).sum(1, keepdims=True))  # a member that knows nothing says nothing to its group
        pair = np.concatenate([np.repeat(self.chain[None], len(chain), 0), tied[np.array(kinds, np.int64)].reshape(-1, len(LABELS), len(LABELS))])
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        msg = np.zeros((len(src), len(LABELS)))
        for _ in range(MOST_ROUNDS):
            total = own.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            new = out[:, :, None] + pot
            top = new.max(1, keepdims=True)
            new = np.log(np.exp(new - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if moved < SETTLED:
                break
        total = own.copy()
        np.add.at(total, dst, msg)
        return _normal(total[:n])


def _normal(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def token_labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """Label number of each token: the kind of a span of the fixed patterns over it.  Both lists are walked once."""
    out = [0] * len(spans)
    for kind in range(len(KINDS)):
        own = [(a, b) for k, a, b in base if k == kind]
        j = 0
        for i, (a, b) in enumerate(spans):
            while j < len(own) and own[j][1] <= a:
                j += 1
            if j < len(own) and own[j][0] < b and not out[i]:
                out[i] = kind + 1
    return out


def prepared(text: str) -> tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, list[int]]], list[int]] | None:
    spans = nodes(text)
    if not spans:
        return None
    chain, groups = links(text, spans)
    return [features(text, *s) for s in spans], chain, groups, token_labels(spans, base_spans(text))


def train(examples: list[tuple], epochs: int = 12, seed: int = 1) -> Field | None:
    """Pseudo-likelihood fit on prepared texts: each token given its neighbours' labels; None without any token of a kind.

    What a group says to a token is the share of each label among its other members.
    """
    if not any(any(e[3]) for e in examples):
        return None
    rng = np.random.default_rng(seed)
    n = len(LABELS)
    feats, y = [f for e in examples for f in e[0]], np.array([label for e in examples for label in e[3]])
    near = np.zeros((len(y), 4, n), np.float32)  # before, after, equal, like-formed
    first = 0
    for f, chain, groups, label in examples:
        for a, b in chain:
            near[first + b, 0, label[a]] += 1
            near[first + a, 1, label[b]] += 1
        for kind, members in groups:
            at = np.array(members)
            count = np.bincount(np.array(label)[at], minlength=n).astype(np.float32)
            others = count[None] - np.eye(n, dtype=np.float32)[np.array(label)[at]]
            near[first + at, 2 + kind] += others / (len(at) - 1)
        first += len(f)
    width = max(map(len, feats))
    fx = np.array([f + [FEATURES] * (width - len(f)) for f in feats])
    field = Field(np.zeros((FEATURES + 1, n)), np.zeros((n, n)), np.zeros((2, n, n)))
    seen_node, seen_chain, seen_skip, seen_agree = np.full((FEATURES + 1, n), 1e-6), np.full((n, n), 1e-6), np.full((2, n, n), 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        hidden = rng.random(len(y)) < 0.5
        for at in range(0, len(y), 64):
            b = order[at:at + 64]
            c = near[b]
            own = np.where(hidden[b, None] & (np.arange(width) > 0), FEATURES, fx[b])  # the first feature is common to all
            s = field.node[own].sum(1) + c[:, 0] @ field.chain + c[:, 1] @ field.chain.T + c[:, 2] @ field.skip[0].T + c[:, 3] @ field.skip[1].T
            d = _normal(s)
            d[np.arange(len(b)), y[b]] -= 1
            d /= len(b)
            g = np.zeros_like(field.node)
            np.add.at(g, own, d[:, None, :])
            rows = np.unique(own)
            gr = g[rows] + 1e-5 * field.node[rows]
            seen_node[rows] += gr * gr
            field.node[rows] -= 0.3 * gr / np.sqrt(seen_node[rows])
            field.node[FEATURES] = 0
            gc = c[:, 0].T @ d + (c[:, 1].T @ d).T + 1e-4 * field.chain
            gs = np.stack([d.T @ c[:, 2], d.T @ c[:, 3]])
            # agreement as such has a weight of its own, so that labels seldom repeated in the sample profit as well
            ga = np.trace(gs, axis1=1, axis2=2)
            seen_agree += ga * ga
            field.skip -= (0.5 * ga / np.sqrt(seen_agree))[:, None, None] * np.eye(n)
            gs = gs + 1e-4 * field.skip
            seen_chain += gc * gc
            seen_skip += gs * gs
            field.chain -= 0.1 * gc / np.sqrt(seen_chain)
            field.skip -= 0.1 * gs / np.sqrt(seen_skip)
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """Fit on the rows that come first by a hash of their id."""
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    some = d.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    d = d.filter((F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike("[0-9@]")).join(F.broadcast(some), "doc_id")  # FIT_ROWS ids at most
    rows = d.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(FIT_ROWS).collect()  # and as many rows
    return train(joined_examples([r.text for r in sorted(rows)]))


def joined_examples(texts: list[str], together: int = 6) -> list[tuple]:
    """Prepared texts, several put end to end and half of them once more, so that the skip links have like and equal tokens to learn from."""
    found = [t for t in texts if NODE.search(t)]
    return [prepared("\n".join([*found[at:at + together], *found[at:at + together:2]])) for at in range(0, len(found), together)]


def scan(text: str, field: Field | None) -> list[dict]:
    """All spans: of the fixed patterns by kind and start, then the field's by kind and start.

    The field adds runs of neighbouring tokens of one label where no fixed pattern has found anything."""
    base = base_spans(text)
    found = [{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for k, a, b in base]
    spans = nodes(text) if field else []
    if spans:
        taken = token_labels(spans, base)
        if not all(taken):
            chain, groups = links(text, spans)
            p = field.marginals([features(text, *s) for s in spans], chain, groups, taken)
            label, sure = p.argmax(1), p.max(1)
            joined = {b for _, b in chain}
            added: list[list] = []
            for i, (a, b) in enumerate(spans):
                if label[i] and sure[i] >= SURE and not taken[i]:
                    while b > a + 1 and text[b - 1] in ".,;:!?\"'":
                        b -= 1
                    if added and i in joined and added[-1][3] == i - 1 and added[-1][0] == label[i]:
                        added[-1][2:] = [b, i, max(added[-1][4], float(sure[i]))]
                    else:
                        added.append([int(label[i]), a, b, i, float(sure[i])])
            found += [{"kind": "crf_" + LABELS[k], "start": a, "end": b, "score": s} for k, a, b, _, s in sorted(added)]
    return found


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None | str = "fit") -> DataFrame:
    """One row per document: spans (kind, start, end, score) in code points, the end exclusive.

    Null text has no span.  Where the sample holds no personal data only the fixed patterns count.
    Repeated rows give repeated results, an empty table an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(fit(docs, id_col, text_col) if field == "fit" else field)

    def start():
        model = sent.value
        return lambda doc, text: ((doc, scan(text or "", model)),)

    return map_rows(pick(docs, id_col, text_col), start, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
