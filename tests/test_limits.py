"""Results do not depend on sizes at which a method changes."""

import pytest
from pyspark.sql import functions as F

from tabwise.operators import ask as A, claims as G, profile as P, quantiles as Q, scorecards as X, sensitive as H
from tabwise.session import local_folder
from tabwise.sources import files as S


def test_claim_score_with_very_many_facts(spark):
    known = spark.range(300_000).select(F.lit("d").alias("dataset"), (F.col("id") * 1000.0).alias("value"))
    claims = spark.createDataFrame([("d", "has 290000000 rows", "table"), ("d", "has 900000000000 rows", "table")], "dataset string, text string, evidence string")
    row = X.claim_score(claims, known).first()
    assert (row.supported, row.unsupported, row.fabricated) == (1, 1, 1)


def test_leak_scan_counts_rows_of_one_id_apart(spark):
    texts = spark.createDataFrame([(1, "alphabeta"), (1, "nothing"), (2, None), (None, "alphabeta alphabeta")], "id long, text string")
    values = spark.createDataFrame([("alphabeta",), ("bet",), ("no",)], "v string")
    got = [sorted((str(r.id), r.leaked) for r in H.leak_scan(texts, "id", "text", values, "v", few=k).collect()) for k in (64, 0)]
    assert got[0] == got[1] == sorted([("1", 2), ("1", 0), ("2", 0), ("None", 2)])


def test_audit_reads_whole_files(spark, tmp_path):
    (tmp_path / "blank.csv").write_text("\n" * 70_000 + "a,b\n1,2\n")
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"1,2\n" * 30_000 + b"caf\xe9,3\n")
    (tmp_path / "cut.csv").write_bytes(b"a,b\n" + b"1,2\n" * 30_000 + "é,3\n".encode())
    got = {r["path"].rsplit("/", 1)[1]: r for r in S.audit_files(spark, str(tmp_path)).collect()}
    assert all(r["is_valid"] for r in got.values())
    assert {k: r["encoding"] for k, r in got.items()} == {"blank.csv": "utf-8", "late.csv": "latin-1", "cut.csv": "utf-8"}


def test_stage_runtimes_total_has_every_stage(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "other", 2.5), (2, "other", None)], "run_id long, stage string, seconds double")
    assert {r.run_id: (r.a, r.total) for r in X.stage_runtimes(m, ["a"]).collect()} == {1: (1.0, 3.5), 2: (None, 0.0)}


def test_questions_beyond_the_plan_limit(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], f"{P.ROW_ID} long, price double, weight double")
    asked = [f"what is the {op} of {c}" for op in ("mean", "sum", "median", "min", "max", "std") for c in ("price", "weight")] * 2 + [None]
    questions = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "no int, text string")
    profile = P.profile_columns(df)
    want = sorted(map(str, A.answer_questions(df, profile, questions).collect()))
    monkeypatch.setattr(A, "MAX_PLANS", 5)
    assert sorted(map(str, A.answer_questions(df, profile, questions).collect())) == want and len(want) == 25


def test_positions_of_large_whole_numbers(spark):
    rows = [(0, 9007199254740993), (1, 9007199254740992), (2, -9007199254740993), (3, None), (4, 9007199254740993)]
    df = spark.createDataFrame(rows, "_row_id long, k long")
    for range_rows in (2_000_000, 1):
        got = {r["_row_id"]: r["position"] for r in Q.global_positions(df, "k", range_rows=range_rows).collect()}
        assert got == {2: 0, 1: 1, 0: 2, 4: 3}


@pytest.mark.parametrize("few", [100_000, 0])
def test_whole_shares_count_as_fractions(spark, few):
    facts = spark.createDataFrame([("d", 25.0, False), ("d", 60.0, True), ("d", 0.0, False)], "dataset_id string, value double, is_int boolean")
    claims = spark.createDataFrame([("d", "25.4 %"), ("d", "60.4 rows"), ("d", "60 rows"), ("d", "0.04 of all")], "dataset_id string, text string")
    got = {r["text"]: r["is_grounded"] for r in G.ground_claims(claims, facts, few_facts=few).collect()}
    assert got == {"25.4 %": True, "60.4 rows": False, "60 rows": True, "0.04 of all": True}


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    with pytest.raises(ValueError):
        local_folder(Context, "x-")
