"""Work is dealt out to all tasks, and grows with the tables."""

from collections import Counter
from pathlib import Path

import pytest

from tabwise.operators import claims as G, models as M
from tabwise.plans import catalog_io
from tabwise.plans.registry import QUERIES
from tabwise.sources import scan, workbook as W


def documents(spark, folder, files=6):
    rows = [(k, f"mail a{k}@example.com é" if k % 2 else None, "en", "src", 10) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(files).write.parquet(f"{folder}/documents.parquet")


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    documents(spark, tmp_path)
    out = QUERIES["mask_stream"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(24)) and {r["source"] for r in out} == {"[REDACTED_ORIGIN]"}
    assert not any(r["text"] and "@example" in r["text"] for r in out)


def test_stream_of_a_table_in_one_file(spark, tmp_path):
    documents(spark, tmp_path / "parts", 1)
    (file,) = (tmp_path / "parts" / "documents.parquet").glob("part-*")
    (tmp_path / "documents.parquet").write_bytes(file.read_bytes())
    assert QUERIES["mask_stream"](spark, str(tmp_path)).count() == 24


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_files_grow_with_the_table(spark, tmp_path, monkeypatch, small_splits):
    documents(spark, tmp_path)
    monkeypatch.setattr(catalog_io, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    assert [r[0] for r in QUERIES["detect_encoding"](spark, str(tmp_path)).collect()] == ["latin-1"]
    assert len([*Path(f"{tmp_path}/latin").glob("part-*")]) > 4


def test_a_task_for_each_file(spark, tmp_path):
    W.write_workbooks(spark.range(60).repartition(6), str(tmp_path / "books"))
    cells = W.read_cells(spark, str(tmp_path / "books"))
    read = cells.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, r["path"]) for r in rows]).collect()
    own = {(i, p) for i, p in read}
    assert len({p for _, p in own}) == 6 and max(Counter(i for i, _ in own).values()) == 1
    listed = scan.list_files(spark, str(tmp_path / "books"))
    assert scan.scan_files(spark, str(tmp_path / "books"), listed).rdd.getNumPartitions() == 6
    table = W.read_workbooks(spark, str(tmp_path / "books")).collect()
    assert sorted(r["id"] for r in table) == [*range(60)] and sorted(r["_row_id"] for r in table) == [*range(60)]
    assert scan.one_each(spark.createDataFrame([], "path string")).count() == 0


def test_workbooks_grow_with_the_table(spark, tmp_path, monkeypatch):
    rows = "cast(id as int) as o_orderkey, cast(id % 5 as int) as o_custkey, 'O' as o_orderstatus, id / 4 as o_totalprice, date'2020-01-01' as o_orderdate, '1-URGENT' as o_orderpriority"
    spark.range(90).selectExpr(*rows.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(catalog_io, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(catalog_io, "BOOK_ROWS", 5)
    out = QUERIES["scan_workbooks"](spark, str(tmp_path)).collect()
    assert sorted(r["o_orderkey"] for r in out) == [*range(90)] and sum(r["note"] is None for r in out) == 18
    assert len([*Path(f"{tmp_path}/books").glob("*.xlsx")]) > 4


def test_facts_go_to_the_claims(spark, monkeypatch):
    claims = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None, f"About {k} units.", "quality", "0.5", "e", "r") for k in range(20)],
                                   "id long, dataset_id string, text string, category string, confidence string, evidence string, recommendation string")
    facts = spark.createDataFrame([("a", 4.0), ("b", 7.0), ("b", 0.13), ("c", 1.0)], "dataset_id string, value double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = G.screen_claims(claims, facts)
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        monkeypatch.setattr(G, "SENT_FACTS", 0)
        other = G.screen_claims(claims, facts)
        assert "SortMergeJoin" in other._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, sent.collect())) == sorted(map(str, other.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["id"] for r in sent.where("accepted").collect()} == {4, 7, 13}


def test_fits_use_all_cores(spark):
    df = spark.range(600).coalesce(1).selectExpr("id as _row_id", "cast(id % 37 as double) as x", "cast(id % 11 as double) as y", "if(id % 37 > 18, 'u', 'v') as target")
    board, models, split = M.train_models(df, "target", ["x", "y"], "classification", "_row_id", trees=3, only=["random_forest"])
    assert split.rdd.getNumPartitions() == M.fit_parts(spark, 600) == spark.sparkContext.defaultParallelism > 1
    assert split.count() == 600 and {r["model"]: r["metrics"].get("f1") for r in board.collect()}["random_forest"] == 1.0
    assert M.fit_parts(spark, 50 * M.PART_ROWS + 1) >= 51
    for task in ("classification", "regression"):
        assert M.candidates(task, 600, 2)["random_forest"].getCacheNodeIds()
    assert not [*spark.sparkContext._jsc.getPersistentRDDs()]


def test_classes_are_boosted_side_by_side(spark):
    ways = [M.candidates("classification", 600, k)["boosted_trees"].getParallelism() for k in (3, 5, 30)]
    assert ways == [3, 5, 8]
