"""Streams over whole files: facts of one file, listing, files above 2 GiB, folders of several kinds."""

import hashlib
import io
import random
import re
import zipfile

import pytest

from tabwise.operators.profile import ROW_ID
from tabwise.sources import files as S, scan
from tests_xlsx import write_xlsx


def brute(content, ext):
    lines = re.split(rb"[\r\n]", content)
    try:
        content.decode("utf-8")
        utf8 = True
    except UnicodeDecodeError:
        utf8 = False
    csv = ext == ".csv"
    return (hashlib.sha256(content).hexdigest(), content[:8], utf8 if csv else None, sum(bool(x.replace(b" ", b"")) for x in lines) if csv else None,
            max(map(len, lines)) if csv else None, bool(re.search(rb"[^,;\t|\s]", content)) if csv else None)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4 << 20])
def test_facts_against_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    r = random.Random(chunk)
    parts = ["a", ",", ";", " ", "\n", "\r\n", "\r", "é", "日", "\t", "|", "\x0b", "  ", "x,y"]
    made = ["".join(r.choices(parts, k=r.randint(0, 40))).encode("utf-8" if r.random() < 0.8 else "latin-1", "replace") for _ in range(300)]
    for content in [b"", b" ", b"\n", b"\r\n\r\n", "é".encode()[:1], b"a\n" + "日".encode()[:2], *made]:
        for ext in (".csv", ".json"):
            got = scan.scan_stream(io.BytesIO(content), ext)
            assert got[:6] == brute(content, ext), content


def test_workbook_directory():
    for names, want in ((["xl/workbook.xml"], (True, True)), (["[Content_Types].xml"], (True, True)), (["a.txt"], (True, False))):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            for n in names:
                z.writestr(n, "x")
        assert scan.scan_stream(io.BytesIO(f.getvalue()), ".xlsx")[6:] == want
    assert scan.scan_stream(io.BytesIO(b"PK\x03\x04 but [Content_Types].xml PK\x05\x06"), ".xlsx")[6] is False


def test_listing(spark, tmp_path):
    for name in ("a.csv", "b/c.csv", "b/d/e é.csv", "b/_hidden.csv", ".h/x.csv", "p=1/_q=2/z.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    (tmp_path / "empty.csv").write_text("")
    want = {(f"file:{tmp_path}/{n}", len(n)) for n in ("a.csv", "b/c.csv", "b/d/e é.csv", "p=1/_q=2/z.csv")} | {(f"file:{tmp_path}/empty.csv", 0)}
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert {tuple(r) for r in scan.list_files(spark, path).collect()} == want
    assert {tuple(r) for r in scan._listed_by_spark(spark, str(tmp_path)).collect()} == want
    assert {r.path for r in scan.list_files(spark, f"{tmp_path}/*.csv").collect()} == {f"file:{tmp_path}/{n}" for n in ("a.csv", "empty.csv")}
    assert [tuple(r) for r in scan.list_files(spark, f"{tmp_path}/a.csv").collect()] == [(f"file:{tmp_path}/a.csv", 5)]
    (tmp_path / "none").mkdir()
    assert scan.list_files(spark, f"{tmp_path}/none").count() == 0


def test_readers_agree(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes("a;b\né;1\n".encode("latin-1"))
    (tmp_path / "b.json").write_bytes(b"{}")
    write_xlsx(tmp_path / "c.xlsx", [["a"], [1]])
    listed = scan.list_files(spark, str(tmp_path))
    one = sorted(map(str, scan.scan_files(spark, str(tmp_path), listed).collect()))
    monkeypatch.setattr(scan, "SCHEMES", {})  # Python opens nothing
    assert sorted(map(str, scan.scan_files(spark, str(tmp_path), listed).collect())) == one


def test_files_above_two_gibibytes(spark, tmp_path):
    big = tmp_path / "big.csv"
    with open(big, "wb") as f:
        f.write(b"a,b\n1,2\n")
        f.truncate(3 << 30)
    (tmp_path / "small.csv").write_text("a,b\n3,4\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in S.audit_files(spark, str(tmp_path)).collect()}
    assert got["small.csv"].is_valid and got["big.csv"].bytes == 3 << 30
    assert got["big.csv"].errors == [f"Dataset has a line of more than {S.MOST_LINE} bytes."]
    digest = hashlib.sha256(b"a,b\n1,2\n")
    for _ in range(3 << 10):
        digest.update(bytes(1 << 20) if _ else bytes((1 << 20) - 8))
    assert got["big.csv"].sha256 == digest.hexdigest()
    table, facts = S.ingest(spark, str(tmp_path))
    assert [(r.a, r.b) for r in table.collect()] == [(3, 4)] and facts.count() == 2


def test_delimited_files_beside_workbooks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;one\n2;two\n")
    (tmp_path / "b.csv").write_text("name,id,more\nthree,3,x\n")
    write_xlsx(tmp_path / "c.xlsx", [["id", "score", "name"], [4, 1.5, "four"], [5, None, None]])
    (tmp_path / "d.json").write_text("{}")
    table, facts = S.ingest(spark, str(tmp_path))
    rows = sorted((r["id"], r["name"], r["more"], r["score"], r[ROW_ID]) for r in table.collect())
    assert [r[:4] for r in rows] == [(1, "one", None, None), (2, "two", None, None), (3, "three", "x", None), (4, "four", None, 1.5), (5, None, None, None)]
    assert sorted(r[4] for r in rows) == list(range(5)) and dict(table.dtypes)["id"] == "bigint"
    assert {(r.file_type, r.is_valid) for r in facts.collect()} == {("csv", True), ("xlsx", True), ("", False)}
