"""Files, workbooks, audits, row ids, sinks, streams."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabwise.operators.profile import ROW_ID
from tabwise.sources import files as S, rowid, sinks
from tabwise.sources.workbook import read_workbooks
from tabwise.streaming import streams as T
from tests_xlsx import write_xlsx


@pytest.mark.parametrize("sep,name", [(",", "comma"), (";", "semicolon"), ("\t", "tab"), ("|", "pipe")])
def test_delimiters_and_ragged_rows(spark, tmp_path, sep, name):
    lines = ["id,name,score", "1,a,1.5", "2,b", "3,c,2.5,extra", "4,d,2.5,", "5,NA,nan", "6,é,3"]
    path = tmp_path / f"{name}.csv"
    path.write_text("\n".join(x.replace(",", sep) for x in lines) + "\n", encoding="utf-8")
    seen = S.inspect_text(spark, str(path)).first()
    assert (seen["delimiter"], seen["encoding"]) == (sep, "utf-8")
    df = S.read_delimited(spark, str(path))
    assert [tuple(r) for r in df.orderBy(ROW_ID).collect()] == [
        (0, 1, "a", 1.5), (1, 2, "b", None), (2, 5, None, None), (3, 6, "é", 3.0),
    ]


def test_latin_and_quotes(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes('id;text;flag\n1;"señor; ""x""";TRUE\n2;café;False\n'.encode("latin-1"))
    assert S.inspect_text(spark, str(path)).first()["encoding"] == "latin-1"
    rows = [tuple(r) for r in S.read_delimited(spark, str(path)).orderBy(ROW_ID).collect()]
    assert rows == [(0, 1, 'señor; "x"', True), (1, 2, "café", False)]


def test_every_file_in_its_own_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a\nb"\n2,"x ""y"", z"\n')
    (tmp_path / "b.csv").write_text("id;name\n3;c\n")
    (tmp_path / "c [1] é%20.csv").write_text("\n\nname,id\nd,4\n")
    (tmp_path / "d.csv").write_bytes("id,name,more\n5,é,0.5\n".encode("latin-1"))
    (tmp_path / "e.csv").write_text("id,name\n6,é\n7,f,too,long\n8\n")
    (tmp_path / "empty.csv").write_text("")
    df = S.read_delimited(spark, str(tmp_path))
    rows = sorted((tuple(r[c] for c in ("id", "name", "more")) for r in df.collect()))
    assert rows == [(1, "a\nb", None), (2, 'x "y", z', None), (3, "c", None), (4, "d", None), (5, "é", 0.5), (6, "é", None), (8, None, None)]
    assert sorted(r[0] for r in df.select(ROW_ID).collect()) == list(range(7))


def test_long_quoted_fields(spark, tmp_path):
    long = "x, " * 50_000
    (tmp_path / "a.csv").write_text(f'id,note\n1,"{long}"\n2,"{long}",over\n3\n')
    assert [(r["id"], len(r["note"] or "")) for r in S.read_delimited(spark, str(tmp_path)).orderBy(ROW_ID).collect()] == [(1, 150_000), (3, 0)]


def test_ingest_leaves_out_refused_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "also [good].csv").write_text("b;a\n4;3\n")
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "data.json").write_text("{}")
    table, facts = S.ingest(spark, str(tmp_path))
    assert sorted((r["a"], r["b"]) for r in table.collect()) == [(1, 2), (3, 4)]
    assert {r["path"].rsplit("/", 1)[1] for r in facts.where("not is_valid and size(errors) = 1").collect()} == {"header.csv", "data.json"}


def test_row_ids_are_dense_over_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("v\n" + "".join(f"{k * 100 + i}\n" for i in range(50)))
    rows = S.read_delimited(spark, str(tmp_path), delimiter=",").orderBy(ROW_ID).collect()
    assert [r[ROW_ID] for r in rows] == list(range(150)) and [r["v"] for r in rows] == [k * 100 + i for k in range(3) for i in range(50)]
    many = rowid.with_row_ids(spark.range(0, 1000, 1, 7)).agg(F.min(ROW_ID), F.max(ROW_ID), F.count_distinct(ROW_ID)).first()
    assert tuple(many) == (0, 999, 1000)


def test_audit(spark, tmp_path):
    files = {
        "good.csv": b"a,b\n1,2\n", "empty.csv": b"", "header.csv": b"a,b\n", "blank.csv": b" \n\n", "exe.csv": b"MZ\x90\x00rest", "pdf.csv": b"%PDF-1.4",
        "fake.xlsx": b"not a zip", "old.xls": b"\xd0\xcf\x11\xe0", "data.json": b"{}", "latin.csv": "a\né\n".encode("latin-1"), "broken.xlsx": b"PK\x03\x04xx", "commas.csv": b",,\n,,\n",
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    write_xlsx(tmp_path / "book.xlsx", [["a"], [1]])
    (tmp_path / "big.csv").write_bytes(b"a\n1\n" + b"2\n" * 600_000)
    got = {r["path"].rsplit("/", 1)[1]: r for r in S.audit_files(spark, str(tmp_path), max_mb=1).collect()}
    assert {n for n, r in got.items() if r["is_valid"]} == {"good.csv", "latin.csv", "book.xlsx"}
    assert "empty" in got["empty.csv"]["errors"][0] and "no data rows" in got["header.csv"]["errors"][0] and "too large" in got["big.csv"]["errors"][0]
    assert "Windows" in got["exe.csv"]["errors"][0] and "PDF" in got["pdf.csv"]["errors"][0] and "zero parseable rows" in got["commas.csv"]["errors"][0]
    assert "zip structure" in got["broken.xlsx"]["errors"][0] and "valid OpenXML" in got["fake.xlsx"]["errors"][0] and "Legacy" in got["old.xls"]["errors"][0]
    assert got["good.csv"]["sha256"] == hashlib.sha256(files["good.csv"]).hexdigest() and got["latin.csv"]["encoding"] == "latin-1"
    assert {r["path"].rsplit("/", 1)[1] for r in S.list_artifacts(spark, str(tmp_path)).collect()} == set(got)


def test_workbooks(spark, tmp_path):
    write_xlsx(tmp_path / "a.xlsx", [["id", "name", "x"], [1, "one", 1.5], [2, None, 2], [None, None, None]])
    write_xlsx(tmp_path / "b.xlsx", [["id", "name", "x"], [3, "three", None]])
    df = read_workbooks(spark, str(tmp_path))
    assert [tuple(r) for r in df.orderBy(ROW_ID).collect()] == [(0, 1, "one", 1.5), (1, 2, None, 2.0), (2, 3, "three", None)]
    table, facts = S.ingest(spark, str(tmp_path))
    assert table.count() == 3 and facts.first()["n_columns"] == 3


def test_ingest_refuses(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,b\n")
    with pytest.raises(ValueError, match="no data rows"):
        S.ingest(spark, str(tmp_path / "bad.csv"))


def test_json_exchange_keeps_types(spark):
    df = spark.createDataFrame([("a", 1, 2.5, True), (None, None, None, None)], "s string, i long, d double, b boolean")
    back = sinks.from_json_lines(sinks.to_json_lines(df), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_intake_processes_each_file_once(spark, tmp_path):
    src, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    rows = [(i, "x" if i % 2 else None, float(i)) for i in range(20)]
    spark.createDataFrame(rows, "k long, c string, v double").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    seen, table = [], T.Intake(str(out), "k")

    def handle(batch, no):
        seen.append(batch.count())
        table.absorb(batch, no)
        table.absorb(batch, no)  # as after a failure

    for _ in range(2):
        T.intake(spark, str(src), schema, handle, str(state)).awaitTermination()
    assert seen == [20]
    table.publish(spark)
    cleaned = spark.read.parquet(f"{out}/cleaned")
    assert cleaned.count() == 20 and cleaned.where("c is null").count() == 0


def test_batches_do_not_change_the_result(spark, tmp_path):
    r = random.Random(6)
    pool = [(r.choice(["12", "7", "3.5", "x", None]), r.choice(["a", "b", None, " "]), r.choice([1.0, 2.0, 500.0, None]), r.choice(["31/12/2020", "01/02/2021", None])) for _ in range(60)]
    rows = [(i, *r.choice(pool)) for i in range(400)]
    r.shuffle(rows)
    schema = "k long, amount string, kind string, v double, day string"
    got = {}
    for name, files in (("one", 1), ("many", 9)):
        src, out = tmp_path / f"{name}-in", tmp_path / name
        for at in range(files):
            spark.createDataFrame(rows[at::files], schema).coalesce(1).write.mode("append").parquet(str(src))
        table = T.Intake(str(out), "k")
        T.intake(spark, str(src), spark.read.parquet(str(src)).schema, table.absorb, str(out) + "-state", files_per_batch=1).awaitTermination()
        done = table.publish(spark)
        assert len(list((out / "landed").glob("_batch=*"))) == files
        got[name] = [sorted(map(str, spark.read.parquet(f"{out}/{x}").collect())) for x in ("profile", "cleaned", "removed")] + [sorted(map(str, done.log_rows)), sorted(map(str, done.outliers.collect()))]
    assert got["one"] == got["many"]
    first = {}
    for row in sorted(rows):
        first.setdefault(row[1:], row[0])
    assert len(got["one"][1]) == len(first) and len(got["one"][2]) == 400 - len(first)


def test_failure_windows(spark, tmp_path):
    src = tmp_path / "m"
    spark.sql("select 'r' || id as run_id, 's' as stage, if(id % 2 = 0, 'failed', 'ok') as status, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as created_at from range(60)").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = T.failure_counts(stream).writeStream.format("memory").queryName("failures").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("failures").agg(F.sum("failures")).first()[0] == 30
