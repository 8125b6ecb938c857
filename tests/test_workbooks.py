"""Workbooks: styles, dates, several sheets, writing."""

import datetime as dt
import random
import zipfile

import pytest

from tabwise.operators.profile import ROW_ID
from tabwise.sources import files as S, workbook as W

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(path, sheet_xml, styles="", book_pr="", shared=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{book_pr}<sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}">{styles}</styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{shared}</sst>')
        for k, xml in enumerate(sheet_xml, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{NS}"><sheetData>{xml}</sheetData></worksheet>')


STYLES = ('<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy&quot; at &quot;hh:mm"/><numFmt numFmtId="165" formatCode="0.00&quot;day&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm"/><numFmt numFmtId="167" formatCode="[Red]#,##0 [$-409]"/></numFmts>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="20"/><xf numFmtId="167"/></cellXfs>')


@pytest.mark.parametrize("code, kind", [("yyyy-mm-dd", "date"), ("d.m.yy h:mm", "date"), ("mmm", "date"), ("h:mm AM/PM", "time"), ("mm:ss", "time"), ("[h]:mm:ss", None), ("0.00", None), ('0 "days"', None),
                                        ("#,##0.00_);[Red](#,##0.00)", None), ("General", None), (r"0\d", None), ("@", None), ("yyyy;@", "date")])
def test_formats(code, kind):
    assert W.format_kind(code) == kind


def test_styles_and_sheets(spark, tmp_path):
    def row(*cells):
        return "<row>" + "".join(cells) + "</row>"

    head = row(*(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in ("day", "moment", "amount", "elapsed", "clock", "mixed", "iso", "text")))
    one = head + row('<c s="1"><v>43831</v></c>', '<c s="2"><v>43831.75</v></c>', '<c s="3"><v>2.5</v></c>', '<c s="4"><v>1.5</v></c>', '<c s="5"><v>0.25</v></c>', '<c s="1"><v>1</v></c>', '<c t="d"><v>2020-02-03T04:05:06</v></c>', '<c t="s"><v>0</v></c>') + row(
        '<c s="1"><v>59</v></c>', '<c/>', '<c s="6"><v>7</v></c>', '<c/>', '<c s="5"><v>0.999988426</v></c>', '<c t="str"><v>word</v></c>', '<c/>', '<c t="e"><v>#N/A</v></c>')
    book(tmp_path / "a.xlsx", [one, row('<c><v>1</v></c>') + row('<c><v>2</v></c>')], STYLES, shared="<si><r><t>two </t></r><r><t>runs</t></r></si>")
    df = W.read_workbooks(spark, str(tmp_path))
    assert [t for _, t in df.drop(ROW_ID).dtypes] == ["timestamp", "timestamp", "double", "double", "string", "string", "timestamp", "string"]
    rows = [tuple(r)[1:] for r in df.orderBy(ROW_ID).collect()]
    assert rows == [
        (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 18), 2.5, 1.5, "06:00:00", "1900-01-01 00:00:00", dt.datetime(2020, 2, 3, 4, 5, 6), "two runs"),
        (dt.datetime(1900, 2, 28), None, 7.0, None, "23:59:59", "word", None, None),
    ]
    assert W.read_workbooks(spark, str(tmp_path), "Two").columns == [ROW_ID, "1"]
    with pytest.raises(Exception, match="sheet 'Three' not found"):
        W.read_workbooks(spark, str(tmp_path), "Three")


def test_dates_since_1904(spark, tmp_path):
    book(tmp_path / "a.xlsx", ['<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>0</v></c></row>', ""], STYLES, '<workbookPr date1904="1"/>')
    assert [r["d"] for r in W.read_workbooks(spark, str(tmp_path)).collect()] == [dt.datetime(1904, 1, 1)]


def test_a_sheet_is_read_as_it_goes(tmp_path):
    n = 60_000
    book(tmp_path / "a.xlsx", ["".join(f'<row r="{i}"><c r="B{i}"><v>{i}</v></c></row>' for i in range(1, n + 1)), ""])
    seen = []
    with open(tmp_path / "a.xlsx", "rb") as f:
        for name, no, cells, stamped in W.workbook_rows(f):
            seen.append((no, cells, stamped))
    assert len(seen) == n and seen[-1] == (n, [None, str(n)], [False, False])


def test_round_trip(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [(i, r.choice([None, "a <b> & \"c\"", " x ", "é\n日"]), r.choice([None, r.random() * 1e6]), r.choice([True, False]), dt.datetime(1950 + i % 100, 1 + i % 12, 1 + i % 28, i % 24, i % 60, i % 60), dt.date(2000 + i % 20, 3, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string, x double, b boolean, at timestamp, day date").repartition(3)
    path = f"file:{tmp_path}/out"
    written = W.write_workbooks(df, path).collect()
    assert sum(w["n"] for w in written) == 300 and len(written) == 3
    back = W.read_workbooks(spark, path)
    assert [t for _, t in back.drop(ROW_ID).dtypes] == ["bigint", "string", "double", "boolean", "timestamp", "timestamp"]
    want = [(*x[:5], dt.datetime(x[5].year, x[5].month, x[5].day)) for x in rows]
    assert sorted((tuple(x)[1:] for x in back.collect()), key=lambda x: x[0]) == want
    table, facts = S.ingest(spark, path)
    assert table.count() == 300 and {f["is_valid"] for f in facts.collect()} == {True}


def test_readers_agree(spark, tmp_path, monkeypatch):
    df = spark.range(40).selectExpr("id", "timestamp_seconds(id * 1000) as at").repartition(2, "id")
    W.write_workbooks(df, str(tmp_path / "x [1]"))
    one = sorted(map(str, W.read_workbooks(spark, str(tmp_path / "x [1]")).drop(ROW_ID).collect()))
    assert len(one) == 40
    names = [f"file:{p}" for p in sorted((tmp_path / "x [1]").glob("*.xlsx"))]
    assert sorted(map(str, W.read_workbooks(spark, names).drop(ROW_ID).collect())) == one
    monkeypatch.setattr(W, "reachable", lambda p: False)  # a store that only Spark reads
    assert sorted(map(str, W.read_workbooks(spark, names).drop(ROW_ID).collect())) == one
