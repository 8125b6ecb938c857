"""What the physical plans may and may not contain, and the registry's shape."""

import os

import pytest
from pyspark.sql import functions as F

import oracle
from tabwise.operators import clean as K, dates as D, profile as P, stats as S
from tabwise.plans.catalog import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
FEW = [
    "ask_group_sum", "ask_value_counts", "value_counts", "duplicate_rate", "infer_types", "dedupe_sidecar", "coerce_money", "null_cells", "outlier_counts",
    "numeric_summary", "pearson_pairs", "hist", "leakage_nmi", "split_stratified", "clf_metrics", "ground_numbers", "mask_documents", "leak_scan", "usage_ledger", "scan_ragged",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 120
    assert len(QUERIES) - len(SQL) <= 14


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TABWISE_ALL") else FEW)
def test_sql_agrees(spark, name):
    verdict, _ = oracle.compare(spark, oracle.connect(SMALL), SMALL, name, QUERIES[name], SQL.get(name))
    assert verdict.split()[0] in ("ok", "rows-only"), verdict


def lines(spark):
    return spark.range(5000).select(
        F.col("id").alias("_row_id"), (F.col("id") % 7).alias("a"), (F.col("id") * 1.5).alias("b"), F.concat(F.lit("k"), F.col("id") % 11).alias("c"), F.lit("01/02/2024").alias("d")
    )


def test_no_python_in_hot_paths(spark):
    df = lines(spark)
    for out in (P.profile_columns(df), D.resolve_dates(df), K.drop_duplicates(df)[1], S.numeric_summary(df, ["a", "b"]), S.pearson_pairs(df, ["a", "b"])):
        assert "Python" not in plan(out) and "Pandas" not in plan(out)


def test_counts_are_summed_before_the_shuffle(spark):
    text = plan(P.value_counts(lines(spark)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_dedupe_has_no_window(spark):
    kept, removed = K.drop_duplicates(lines(spark), ["a", "c"])
    assert "Window" not in plan(kept) and "partial_min" in plan(kept) and "Window" not in plan(removed)


def test_summary_moves_no_rows(spark, tmp_path):
    lines(spark).write.parquet(str(tmp_path / "t"))
    text = plan(S.pearson_pairs(spark.read.parquet(str(tmp_path / "t")), ["a", "b"]))
    assert "hashpartitioning" not in text and "ReadSchema: struct<a:bigint,b:" in text


def test_top_values_are_cut_in_every_task(spark):
    counts = S.categorical_counts(lines(spark), ["c"])
    assert "WindowGroupLimit" in plan(S.top_values(counts))


def test_same_result_under_other_partitioning(spark):
    df = lines(spark)
    before = sorted(map(str, P.profile_columns(df).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(map(str, P.profile_columns(df.repartition(9)).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_queries_train_with_the_defaults(monkeypatch):
    from tabwise.plans import catalog_io, catalog_models

    class Seen(Exception):
        pass

    def seen(*args, **named):
        raise Seen(named)

    for name in ("view", "table"):
        for module in (catalog_io, catalog_models):
            monkeypatch.setattr(module, name, lambda *a: type("T", (), {"drop": lambda s, *c: s, "withColumn": lambda s, *c: s})())
    for name in ("train_models", "model_status"):
        monkeypatch.setattr(catalog_models.M, name, seen)
    monkeypatch.setattr(catalog_models.P, "profile_columns", lambda *a: None)
    monkeypatch.setattr(catalog_io, "analyse", seen)
    monkeypatch.setattr(catalog_io.F, "col", lambda *a: None)
    for name in ("leaderboard_classification", "leaderboard_regression", "feature_importance", "model_status", "full_analysis"):
        with pytest.raises(Seen) as found:
            QUERIES[name](None, SMALL)
        assert not set(found.value.args[0]) & {"trees", "rounds", "train"} and (name == "feature_importance" or "only" not in found.value.args[0]), name
