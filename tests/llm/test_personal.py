import random
import re

import numpy as np

from tabwise.llm import personal as P

RAW = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]
TEXTS = [
    "bosbt.42@mail8.example.com and +1 (724) 555-7058", "a@b.c@d.e x@y@z.w a@b.c-x_y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4", "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796", "12 4041894974608795", "+49 (0)30.123-456 +1 2",
    "", None, "@", "@@..", "1" * 30_000, "a" * 30_000, "a@" * 5_000, "+1" + " " * 20_000, "²³ x².3 1² 5.²", "é12@é.com ٣٤٥", "192.168.0.1 then 10.0.0.7 and 999.999.999.999",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in enumerate(RAW):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_fixed_patterns_against_brute_force():
    r = random.Random(7)
    made = ["".join(r.choices(["1", "23", "456", "0", ".", "@", "a", "-b", "_", "+", "+4", " ", "-", "(", ")", "é", "4041894974608795", "%", "\n"], k=r.randint(1, 25))) for _ in range(4000)]
    for t in [t for t in TEXTS if len(t or "") < 1000] + made:
        assert P.base_spans(t or "") == brute(t), t
    for t in TEXTS:
        P.base_spans(t or ""), P.nodes(t or ""), P.prepared(t or "")


def corpus(n, seed):
    r = random.Random(seed)

    def word():
        return "".join(r.choices("abcdefg", k=r.randint(2, 7)))

    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 30))]
        for _ in range(r.randint(0, 3)):
            w.insert(r.randrange(len(w)), r.choice([f"{word()}{r.randrange(99)}@mail.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", f"v{r.randrange(9)}.{r.randrange(9)}", str(r.randrange(1990, 2030))]))
        out.append((i, " ".join(w)))
    return out


def trained():
    return P.train(P.joined_examples([t for _, t in corpus(400, 1)]))


def test_field_labels_follow_distant_tokens():
    field = trained()
    hit = total = 0
    for _, t in corpus(150, 2):
        if (x := P.prepared(t)):
            p = field.marginals(*x[:3])
            hit += int((p.argmax(1) == x[3]).sum())
            total += len(x[3])
    assert hit > 0.97 * total
    # equal tokens pull each other, however many lie between them
    assert all(field.skip[0][k, k] > max(np.delete(field.skip[0][:, k], k)) for k in (1, 2, 4))
    for copies in (2, 60):
        tied = field.marginals([[]] * copies, [], [(0, list(range(copies)))], [2] + [0] * (copies - 1))
        assert (tied[1:, 2] > 0.5).all() and np.ptp(tied[1:, 2]) < 1e-3


def test_a_document_differs_without_skip_links():
    field = trained()
    bare = P.Field(field.node, field.chain, np.zeros_like(field.skip))
    text = "reach me at +1 (724) 555-7058 any day. " + "word " * 200 + "if busy, ring 555-7058 or ask for 555-7058 there"
    spans = {(s["start"], text[s["start"]:s["end"]]) for s in P.scan(text, field) if s["kind"] == "crf_phone"}
    assert {t for _, t in spans} == {"555-7058"} and len(spans) == 2
    assert P.scan(text, bare) != P.scan(text, field) and P.scan(text, bare)[:1] == P.scan(text, field)[:1]
    # without the full number nothing is told
    assert [s for s in P.scan(text[39:], field) if s["kind"] == "crf_phone"] == []


def test_messages_settle():
    field = trained()
    r = random.Random(3)
    for _, t in corpus(40, 9):
        text = " ".join([t] * r.randint(1, 30))
        if (x := P.prepared(text)):
            before, P.MOST_ROUNDS = P.MOST_ROUNDS, 2 * P.MOST_ROUNDS
            more = field.marginals(*x[:3])
            P.MOST_ROUNDS = before
            assert np.abs(field.marginals(*x[:3]) - more).max() < 0.01


def test_rows_of_the_fit_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "FIT_ROWS", 5)
    seen = []
    monkeypatch.setattr(P, "train", lambda e: seen.append(e))
    monkeypatch.setattr(P, "joined_examples", lambda texts: texts)
    df = spark.createDataFrame([(7, f"mail a{i}@b.cd") for i in range(400)], "doc_id long, text string")
    P.fit(df)
    assert len(seen[0]) == 5


def test_rows(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, None), (None, TEXTS[2], "q", 3)] + [(100 + i, t, "c", 1) for i, t in corpus(60, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, Text int").repartition(3)
    texts = {i: t for i, t, _, _ in rows}
    out = P.find_personal(df).collect()
    assert len(out) == len(rows)
    for r in out:
        base = [(P.KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.kind in P.KINDS]
        assert len(texts[r.doc_id] or "") > 1000 or base == brute(texts[r.doc_id])
        assert base == [(P.KINDS.index(s.kind), s.start, s.end) for s in r.spans][:len(base)]
    assert P.find_personal(df.limit(0)).count() == 0
