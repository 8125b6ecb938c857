"""Trees grown from cells say what Spark's own trees say."""

import numpy as np
import pytest
from pyspark.ml import classification as C, regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwise.operators import cells as X, models as M, profile as P


@pytest.fixture(scope="module")
def cases(spark):
    return spark.range(2400).coalesce(1).selectExpr(
        "id as _row_id", "if(id % 19 = 0, null, cast(id * 7 % 29 as double)) as x", "cast(id * 31 % 101 as double) / 10 as z",
        "case when id % 5 = 0 then null when id % 5 < 3 then 'u' else 'v' end as kind",
        "if(id * 7 % 29 + id % 5 * 6 > 30, 'yes', 'no') as target", "cast(id * 7 % 29 as double) * 3 + id % 5 + (id * 13 % 7) / 7 as amount",
    )


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 0)


@pytest.mark.parametrize("counted, label", [(True, "if(target = 'yes', 1.0D, 0.0D)"), (False, "amount")])
def test_a_tree_of_all_rows_is_sparks(spark, cases, counted, label):
    same = {"numTrees": 1, "bootstrap": False, "maxDepth": 8, "minInstancesPerNode": 2}
    est = C.RandomForestClassifier(weightCol="weight", **same) if counted else R.RandomForestRegressor(**same)
    df = cases.selectExpr("*", f"{label} as label", "if(target = 'yes', 0.7D, 1.4D) as weight", "_row_id % 5 = 4 as is_test")
    stages, kept = M.feature_stages(df.where("not is_test"), ["x", "kind"])
    split = M.feature_inputs(df, ["x", "kind"], kept).cache()
    train = split.where("not is_test")
    prep, points = M.fit_stages(stages, train)
    at_once = prep.transform(split).select(vector_to_array("features").alias("a"), vector_to_array(X.features_of(prep)).alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"], abs=1e-12) for r in at_once)
    cells = X.find_cells(split, prep, points, 2 if counted else 0)
    own = train.select(cells.code.alias("c"), "label").toPandas()
    place = np.searchsorted(cells.codes, own["c"])
    if counted:
        stats, raw = cells.counts * cells.weights, cells.counts.sum(1).astype(float)
        assert cells.counts.sum() == len(own)
    else:
        stats = X.by_place(place, np.stack([own["label"] ** k for k in range(3)], 1), len(cells.codes))
        raw = stats[:, 0]
    nodes, value = X.grow(cells.bins, cells.edges, stats, raw, np.random.default_rng(0), cells.bins.shape[1], 8, 2, counted)
    model = est.fit(prep.transform(train))
    said = model.transform(prep.transform(train)).select(cells.code.alias("c"), "prediction").toPandas()
    assert value[np.searchsorted(cells.codes, said["c"])] == pytest.approx(said["prediction"].to_numpy())
    assert len(nodes["left"]) == model.totalNumNodes and nodes["gain"][0] == pytest.approx(model.trees[0]._call_java("rootNode").gain())
    split.unpersist()


def test_large_tables_are_staged_lean(spark, cases, monkeypatch, large):
    monkeypatch.setattr(X, "CHUNK_ROWS", 300)
    monkeypatch.setattr(X, "DRAWN_ROWS", 64)
    monkeypatch.setattr(X, "HELD_BYTES", 24 * 2 * 800)  # trees are drawn in several turns
    board, models, split = M.train_models(cases, "amount", ["x", "z", "kind"], "regression", "_row_id", trees=5, rounds=5, only=["random_forest", "boosted_trees"])
    assert all(f.endswith(".parquet") for f in split.inputFiles()) and split.count() == 2400 and {*cases.columns} < {*split.columns}
    got = {r["model"]: r["metrics"] for r in board.collect()}
    assert got["random_forest"]["r2"] > 0.8 and got["boosted_trees"]["r2"] > 0.8
    for name, model in models.items():
        last = model.stages[-1]
        assert last.getNumTrees == 5 and last.numFeatures == 7 and last.featureImportances.toArray().argmax() == 0
        assert M.regression_metrics(model.transform(split.where("is_test")), "label", "prediction").first().asDict() == got[name]
    assert sum(t._call_java("rootNode").impurityStats().count() for t in models["random_forest"].stages[-1].trees) != 5 * 1920  # drawn with replacement
    assert list(models["boosted_trees"].stages[-1].treeWeights) == [1.0] + [0.1] * 4


def test_classes_against_the_rest(spark, cases, large):
    df = cases.withColumn("target", F.concat(F.lit("c"), (F.col("x") / 10).cast("int")))
    board, models, split = M.train_models(df, "target", ["x", "kind"], "classification", "_row_id", rounds=2, only=["boosted_trees"])
    model, test = models["boosted_trees"].stages[-1], split.where("is_test")
    assert isinstance(model, C.OneVsRestModel) and len(model.models) == 3
    assert M.classification_metrics(models["boosted_trees"].transform(test), "label", "prediction").first().asDict() == {r["model"]: r["metrics"] for r in board.collect()}["boosted_trees"]
    assert M.feature_importance(models["boosted_trees"], models["boosted_trees"].transform(test)).first()["importance"] > 0.9


def test_draws():
    w = X.draws(np.arange(20_000), range(3, 20), 42, None)
    assert w.shape == (20_000, 17) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 6
    assert abs(np.corrcoef(w.T.astype(float)) - np.eye(17)).max() < 0.05
    assert (w[:, 1:] == X.draws(np.arange(20_000), range(4, 20), 42, None)).all()  # whatever the turns
    assert abs(X.draws(np.arange(20_000), range(5), 42, 0.9).mean() - 0.9) < 0.01


def test_too_many_cells_are_left_to_spark(spark, cases, monkeypatch, large):
    monkeypatch.setattr(X, "MOST_CELLS", 10)
    monkeypatch.setattr(M, "fit_cells", None)
    held = {*spark.sparkContext._jsc.getPersistentRDDs()}
    board, models, _ = M.train_models(cases, "amount", ["x", "z"], "regression", "_row_id", trees=2, only=["random_forest"])
    assert models["random_forest"].stages[-1].getNumTrees == 2 and {*spark.sparkContext._jsc.getPersistentRDDs()} <= held


def test_the_profile_is_taken_once(spark, cases, monkeypatch):
    class Seen(Exception):
        pass

    def audit(df, profile, *rest):
        raise Seen(profile._jdf.queryExecution().optimizedPlan().toString())

    df = cases.drop("amount")
    monkeypatch.setattr(M, "leakage_audit", audit)
    with pytest.raises(Seen) as seen:
        M.model_status(df, P.profile_columns(df), "_row_id", "target")
    assert "Aggregate" not in str(seen.value) and "Range" not in str(seen.value)
