"""Models of many classes, saved artefacts."""

import random
import shutil

import pytest

from tabwise.operators import models as M


@pytest.fixture(scope="module")
def three(spark):
    r = random.Random(2)
    rows = []
    for i in range(700):
        k = r.choice("abc")
        x = {"a": 0.0, "b": 3.0, "c": 6.0}[k] + r.gauss(0, 0.8)
        rows.append((i, x, r.random(), r.choice(["u", "v", None]), f"class {k}", 1.0))
    return spark.createDataFrame(rows, "_row_id long, x double, noise double, kind string, target string, weight double")


def test_boosting_for_three_classes(spark, three, tmp_path):
    board, models, split = M.train_models(three.drop("weight"), "target", ["x", "noise", "kind"], "classification", "_row_id", rounds=2, only=["boosted_trees"])
    got = {r["model"]: r for r in board.collect()}
    assert got["boosted_trees"]["status"] == "trained" and got["boosted_trees"]["metrics"]["f1"] > 0.9 > got["baseline"]["metrics"]["f1"]
    test = split.where("is_test")
    scored = M.one_against_rest(models["boosted_trees"].transform(test)).collect()
    for r in scored:
        assert abs(sum(r["probability"]) - 1) < 1e-9 and max(range(3), key=lambda k: r["probability"][k]) == r["prediction"]
    top = M.feature_importance(models["boosted_trees"], models["boosted_trees"].transform(test)).first()
    assert top["feature"].endswith("0") or "x" in top["feature"]
    out = M.save_and_verify(models["boosted_trees"], test, str(tmp_path / "m"), 10**6).collect()
    assert len(out) == test.count() and all(r["prediction"] == r["reloaded"] for r in out)


def test_classes_joined_either_way(spark, three, monkeypatch):
    boards = []
    for few in (M.FEW_CLASSES, 1):
        monkeypatch.setattr(M, "FEW_CLASSES", few)
        board, models, split = M.train_models(three.drop("weight"), "target", ["x"], "classification", "_row_id", only=["logistic_regression"])
        boards.append((sorted(map(str, board.collect())), sorted(tuple(r) for r in split.select("_row_id", "label", "is_test", "weight").collect())))
    assert boards[0] == boards[1]
    names = three.select("_row_id", "target").collect()
    labels = {r[0]: r[1] for r in boards[0][1]}
    assert all(labels[n["_row_id"]] == "abc".index(n["target"][-1]) for n in names)


def test_many_classes(spark):
    df = spark.range(30_000).selectExpr("id as _row_id", "cast(id % 12000 as string) as target")
    table = M.class_table(df, "target").collect()
    assert [r["class"] for r in sorted(table, key=lambda r: r["label"])] == sorted({str(k) for k in range(12_000)}) and {r["label"] for r in table} == set(range(12_000))


def test_digest_of_an_artefact(spark, tmp_path):
    a = tmp_path / "a"
    (a / "metadata").mkdir(parents=True)
    (a / "metadata" / "part-00000").write_text("one")
    (a / "data.bin").write_bytes(b"two")
    first = M.artifact_digest(spark, str(a))
    assert (first["files"], first["bytes"]) == (2, 6)
    shutil.copytree(a, tmp_path / "b")
    assert M.artifact_digest(spark, f"file:{tmp_path}/b/") == first
    (tmp_path / "b" / "data.bin").write_bytes(b"tw0")
    assert M.artifact_digest(spark, str(tmp_path / "b"))["digest"] != first["digest"]
    shutil.copytree(a, tmp_path / "c")
    (tmp_path / "c" / "data.bin").rename(tmp_path / "c" / "other.bin")
    assert M.artifact_digest(spark, str(tmp_path / "c"))["digest"] != first["digest"]


def test_an_artefact_that_changes_is_refused(spark, three, tmp_path, monkeypatch):
    _, models, split = M.train_models(three.drop("weight"), "x", ["noise"], "regression", "_row_id", only=["ridge"])
    real, seen = M.artifact_digest, []

    def changing(spark, path):
        seen.append(path)
        if len(seen) == 2:
            (tmp_path / "m" / "extra").write_text("x")
        return real(spark, path)

    monkeypatch.setattr(M, "artifact_digest", changing)
    with pytest.raises(ValueError, match="changed"):
        M.save_and_verify(models["ridge"], split, str(tmp_path / "m"))
