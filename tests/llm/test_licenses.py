import random
import re
import time

from tabwise.llm import licenses as L


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


ROWS = [
    (1, "Released under the MIT License."), (2, "x MIT\nlicense mit-License and the Apache License, Version 2.0!"), (3, None), (4, ""), (5, "GNU General\tPublic License, version 3"),
    (6, "mitlicense ÀMIT license É mit license"), (7, "licensed under CC BY-NC 4.0."), (8, "permission is hereby granted, free of charge, to any person obtaining a copy"), (8, "mit license mit license"),
    (None, "general public license"), (9, "a b " * 40_000 + "mit license"), (10, "İMIT LICENSE mit license"), (11, "nothing to see here, though it is licensed"),
]


def test_base_places_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(df).collect()), key=repr)
    assert got == sorted(((i or -1, *brute(t)) for i, t in ROWS), key=repr)


def test_rules_priorities_and_suppression():
    assert len(L.rules()) > 300
    _, _, spans = L.scan_text("This file is licensed under the GNU Lesser General Public License version 3")
    assert [s[2] for s in spans] == ["lgpl-3.0"] and spans[0][3] == 0.95
    _, _, spans = L.scan_text("SPDX-License-Identifier: Apache-2.0\nthen the MIT License")
    assert [(s[2], s[3]) for s in spans] == [("apache-2.0", 1.0), ("mit", 0.7)]
    assert [s[2] for s in L.scan_text("Licensed under CC BY-NC 4.0.")[2]] == ["cc-by-nc"]
    assert L.scan_text("free text about general things under the sun")[2] == []


def test_gate_hides_no_detection():
    samples = [f"x {name} y" for _, _, name, short in L.LICENSES for name in (re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", name), "license " + re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", short))]
    for s in samples:
        line = b" " + s.replace("[sc]", "s").replace("?", "").encode() + b" "
        if L.detect(line):
            assert any(g in line for g in L.GATE), line


def test_empty_table_and_other_columns(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels int")).count() == 0
    df = spark.createDataFrame([(1, "mit license", "x", None)], "doc_id long, text string, Text string, labels string")
    assert [r.labels for r in L.scan_licenses(df).collect()] == ["mit"]


def spelled(text):
    """All texts that an expression of the rules matches."""
    def many(nodes):
        out = [""]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                ends = [chr(arg)]
            elif name == "IN":
                ends = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else [*range(a[0], a[1] + 1)])]
            elif name == "MAX_REPEAT":
                ends = ["", *many(arg[2])]
                assert arg[:2] == (0, 1)
            elif name == "SUBPATTERN":
                ends = many(arg[3])
            else:
                assert name == "BRANCH", name
                ends = [x for branch in arg[1] for x in many(branch)]
            out = [a + b for a in out for b in ends]
        return out
    return many(re._parser.parse(text))


def test_keywords_hide_no_alternative():
    names = [(label, key, x) for label, key, name, _ in L.LICENSES for x in spelled(name)]
    for label, key, name in names:
        assert any(k in name for k in key.split("|")), (label, key, name)
        assert any(g in f" {name} ".encode() for g in L.GATE), name
    for _, word, _, form in L.FORMS:
        for x in spelled(form.replace("{name}", "N").replace("{short}", "S")):
            assert not word or any(k in x for k in word.split("|")), (word, x)
    for _, _, word, _, text in L.MARKS:
        for x in spelled(text):
            assert any(k in x for k in word.split("|")) and any(g in x.encode() for g in L.GATE), x


def test_detections_are_the_same_without_keywords(monkeypatch):
    texts = [x for _, _, name, short in L.LICENSES for n in (spelled(name)[::7], spelled(short)[:2]) for y in n for x in (y, "see the " + y, "license " + y)]
    lines = [f" a {x} b ".encode() for x in texts]
    got = [L.detect(line) for line in lines]
    bare = [(p, label, (), w, e) for p, label, _, w, e in L.rules()]
    monkeypatch.setattr(L, "rules", lambda: bare)
    assert got == [L.detect(line) for line in lines]
    assert [L.scan_text(t)[2][0][2:] for t in ("X11 License", "see the Expat License", "Free Public License 1.0.0")] == [("mit", 0.7), ("mit", 0.85), ("bsd-0-clause", 0.7)]


def test_no_derivative_works_is_not_the_weaker_license():
    text = "licensed under a Creative Commons Attribution-Noncommercial-No Derivative Works 3.0 License"
    assert [x[2] for x in L.scan_text(text)[2] if x[2].startswith("cc")] == ["cc-by-nc-nd"]


def plain_suppression(line):
    """Detections with every hit compared to every kept one."""
    hits = [(-p, m.start() - m.end(), m.start(), k, m.end(), label, w) for k, (p, label, _, w, e) in enumerate(L.rules()) for m in e.finditer(line)]
    kept = []
    for low, _, start, _, end, label, w in sorted(hits):
        if not any(a <= start and end <= b for a, b, _, _ in kept) and not (-low <= L.WEAK and any(a < end and start < b for a, b, _, _ in kept)):
            kept.append((start, end, label, w))
    return sorted(kept)


def test_suppression_against_all_pairs():
    r = random.Random(8)
    names = [x for _, _, name, short in L.LICENSES for x in (*spelled(name)[:2], *spelled(short)[:1])] + [x for m in L.MARKS for x in spelled(m[4])[:1]]
    glue = ["licensed under the", "see the", "or", "spdx license identifier", "license is", "this work is licensed under", "and", "copyright 2020"]
    for _ in range(150):
        words = " ".join(r.choice(glue if r.random() < 0.6 else names) for _ in range(r.randint(1, 25)))
        line = f" {words} ".encode()
        assert L.detect(line) == plain_suppression(line), words
        n, _, spans = L.scan_text(words)
        at = [(line.count(b" ", 0, a - 1), line.count(b" ", 0, b)) for a, b, _, _ in L.detect(line)]
        assert [(a, b) for a, b, _, _ in spans] == at and all(0 <= a < b <= n for a, b in at)


def test_long_lists_of_licenses_take_linear_time():
    text = "Released under the MIT License, see the Apache License 2.0. " * 35_000
    start = time.process_time()
    n, base, spans = L.scan_text(text)
    took = time.process_time() - start
    assert n == 11 * 35_000 and len(base) == 70_000 and len(spans) == 70_000
    small = time.process_time()
    L.scan_text(text[:len(text) // 8])
    small = time.process_time() - small
    assert took < 20 * small + 2, (took, small)


def test_clauses_of_their_own():
    for text, label in (("You may not use this file except in compliance with the License.", "apache-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
                        ("The Software shall be used for Good, not Evil.", "json"), ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
                        ("This is free and unencumbered software released into the public domain.", "unlicense")):
        assert label in [x[2] for x in L.scan_text(text)[2]], text
