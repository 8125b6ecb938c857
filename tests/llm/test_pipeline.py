import os
import random

import pytest

import corpus_pipeline as C
from tabwise.llm import decontaminate, secrets, simhash, toxicity
from tabwise.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
def test_stages_against_their_operators(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    clean = C.drop_toxic(spark, docs, SMALL).cache()
    rejected = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, SMALL, "labels")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected
    single = C.drop_near_duplicates(spark, clean, SMALL).cache()
    marked = simhash.near_duplicates(clean).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in marked})
    free = C.drop_contaminated(spark, single, SMALL).cache()
    leaks = {r.doc_id for r in decontaminate.find_leaks(single, table(spark, SMALL, "benchmark")).collect()}
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r in single.collect()} - leaks
    safe = C.redact_secrets(spark, free, SMALL).cache()
    assert safe.count() == free.count() and not any(secrets.base_findings(r.text) and "[SECRET]" not in r.text for r in safe.collect())
    for d in (clean, single, free, safe):
        assert d.columns == columns and d.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    mixed = C.mix_sources(spark, safe, SMALL).collect()
    words = sum(len(r.text.split()) for r in safe.collect())
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * words) < 0.05 * words


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "A B c d", "y"), (None, "e f g h", None), (None, "e f g h", "q"), (3, None, "z"), (4, "", "z"), (3, "zz yy xx", "z")]
    out = simhash.drop_near_duplicates(spark.createDataFrame([(*r, 5, "a.b") for r in rows], "doc_id long, text string, _row string, k1 int, `row.x` string"))
    assert out.columns == ["doc_id", "text", "_row", "k1", "row.x"] and {r["_row"] for r in out.collect()} <= {"x", "q", "z", None} and {r["row.x"] for r in out.collect()} == {"a.b"}
    out = out.select("doc_id", "text")
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "e f g h"), (1, "a b c d"), (3, ""), (3, "zz yy xx")]
    assert simhash.drop_near_duplicates(out.limit(0)).count() == 0


def corpus(n=60):
    r = random.Random(5)
    words = ["w%c%c" % (a, b) for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(20, 60))), "en", r.choice(["x", "y", None]), 1) for i in range(n)]
    rows += [(100, None, None, None, None), (101, "", "en", "x", 0), (None, "one two three four", "en", "y", None), (102, rows[3][1], "en", "y", 9), rows[4], rows[4],
             (103, "password = hunter2hunter2 and " + rows[5][1], "en", "x", 1), (104, "so it says: which river runs through the old town of Exampleville then", "en", "x", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, schema=SCHEMA, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema + "".join(f", {c} int" for c in ("_row", "shard")[:len(extra)]))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Which river runs through the old town of Exampleville"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_with_nulls_and_clashing_names(spark, tmp_path):
    rows = corpus()
    out = C.run(spark, written(spark, tmp_path / "a", rows, extra=(7, 8))).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "_row", "copy", "shard", "place"} and {r["_row"] for r in out} == {7}
    ids = {r["doc_id"] for r in out}
    assert 104 not in ids and 102 not in ids and 3 in ids  # a benchmark item, and a copy of a smaller id
    kept = [r for r in rows if r[0] not in (102, 104)]
    words = sum(len(t.split()) for t in {(r[0], r[1]): r[1] or "" for r in kept}.values())
    assert abs(sum(len((r["text"] or "").split()) for r in out) - 1.5 * words) <= 70
    assert all("hunter2" not in (r["text"] or "") for r in out) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    # every document is taken as often as its source asks, in shards that hold whole rows
    assert {(r["doc_id"], r["copy"]) for r in out} and max(r["copy"] for r in out) <= 1


def test_run_of_an_empty_table(spark, tmp_path):
    assert C.run(spark, written(spark, tmp_path / "b", [])).count() == 0
