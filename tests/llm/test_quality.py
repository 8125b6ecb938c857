import re

import pytest

from tabwise.llm import quality as Q
from tabwise.llm.queries import SQL

ROWS = [
    (1, "One two three four five six seven eight. " * 8), (2, None), (3, ""), (4, "a b c d a b c"), (5, "same line here now.\n" * 30 + "x y z"), (6, "Home | About | Contact | Help | More\n" * 20),
    (7, "\n".join(f"word{i} and more text follows on this line number {i}." for i in range(20)) + "\nsubscribe now\nSign in"), (7, "w&&& x%%% " * 60), (None, "é ü " * 60), (8, "q " * 5_000 + "r s t " * 2_000),
    (9, " \t\n \n"), (10, "a\nb\na\n\n\na"), (11, "short\nlines\nonly"), (12, "it’s “quoted” 😀 text… " * 15),
]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(Q.SYMBOLS, text)), dup, len(covered)


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.judge_quality(df).collect())
    assert got == sorted((i or -1, *brute(t)) for i, t in ROWS)


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    import oracle

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by name below
    con = duckdb.connect()
    con.register("documents", documents)
    cur = con.execute(SQL["op4_quality_rules"])
    names = [c[0] for c in cur.description]
    got = Q.judge_quality(df).drop("cleaned")
    assert oracle.rows_of(names, cur.fetchall()) == oracle.rows_of(got.columns, got.collect())


def test_verdicts(spark):
    out = {r.doc_id: r for r in Q.judge_quality(spark.createDataFrame([r for r in ROWS if r[0] in (1, 6)] + [(20, "\n".join(" ".join(f"w{i}{c}" for c in "abcdefgh") + "." for i in range(12)) + "\nRead more\nHome | A | B | C")], "doc_id long, text string")).collect()}
    assert out[20].kept and out[20].n_lost_words == 9 and "Read more" not in out[20].cleaned and "Home" not in out[20].cleaned
    assert not out[6].kept


def test_no_python_in_the_plan_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n int, Words string")
    out = Q.judge_quality(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1
    assert Q.judge_quality(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0
