"""Workbooks (.xlsx) of a folder as one table, and tables as workbooks; one task reads one workbook at a time.

A sheet is parsed as it is read, row by row; only the workbook's shared strings are held.  Numbers whose
cell style is a date become timestamps.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import na_to_null, q
from tabwise.operators.profile import ROW_ID
from tabwise.session import checkpoint_cut, local_table, ship
from tabwise.sources.rowid import with_row_ids
from tabwise.sources.scan import list_files, locate, one_each, reachable
from tabwise.sources.typing import to_physical_types

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row_no long, cells array<string>, stamped array<boolean>"
ROWS_AT_ONCE = 2_000


def _column_no(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def format_kind(code: str) -> str | None:
    """'date' or 'time' for a number format that shows one, else None."""
    if re.search(r"\[[hms]+\]", code, re.I):  # elapsed time is a number
        return None
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code.split(";")[0]).lower()
    if re.search(r"[yd]", bare) or re.search(r"m{3,}", bare) or re.fullmatch(r"\s*m+\s*", bare):
        return "date"
    return "time" if re.search(r"[hs]", bare) else None


def style_kinds(z: zipfile.ZipFile) -> list[str | None]:
    """Kind of number that each cell style shows."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): format_kind(f.get("formatCode", "")) for f in root.iter(_NS + "numFmt")}
    known = {**{i: "date" for i in V.DATE_FORMAT_IDS}, **{i: "time" for i in V.TIME_FORMAT_IDS}, **own}
    styles = root.find(_NS + "cellXfs")
    return [known.get(int(x.get("numFmtId", 0))) for x in styles] if styles is not None else []


def from_serial(number: float, kind: str, since_1904: bool) -> str | None:
    """ISO text of a day number; a time is what is left of the day."""
    if kind == "time" and 0 <= number < 1:
        at = datetime(2000, 1, 1) + timedelta(milliseconds=round(number * 86_400_000))
        return at.strftime("%H:%M:%S")
    first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if number >= 60 else datetime(1899, 12, 31)
    try:
        return (first + timedelta(milliseconds=round(number * 86_400_000))).isoformat(sep=" ", timespec="milliseconds").removesuffix(".000")
    except OverflowError:
        return None


def workbook_rows(file: BinaryIO, sheet: str | int = 0) -> Iterator[tuple[str, int, list, list]]:
    """(sheet, row number, cell texts, which of them are dates) of one sheet, by name or position."""
    with zipfile.ZipFile(file) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, si in ElementTree.iterparse(f):
                    if si.tag == _NS + "si":
                        shared.append("".join(t.text or "" for t in si.iter(_NS + "t")))
                        si.clear()
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), rels[s.get(_REL)]) for s in book.iter(_NS + "sheet")]
        since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(_NS + "workbookPr"))
        kinds = style_kinds(z)
        picked = [s for i, s in enumerate(sheets) if sheet in (i, s[0])]
        if not picked:
            raise ValueError(f"sheet {sheet!r} not found")
        name, target = picked[0]
        target = target.lstrip("/")
        target = target if target.startswith("xl/") else "xl/" + target
        number = 0
        with z.open(target) as f:
            data = None
            for event, row in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = row if row.tag == _NS + "sheetData" else data
                    continue
                if row.tag != _NS + "row":
                    continue
                cells, stamped = [], []
                for c in row.iter(_NS + "c"):
                    at = _column_no(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    stamped += [False] * (at + 1 - len(stamped))
                    cells[at], stamped[at] = _cell(c, shared, kinds, since_1904)
                number = int(row.get("r", number + 1))
                yield name, number, cells, stamped
                if data is not None:
                    data.clear()  # rows that were read leave the tree


def _cell(c: ElementTree.Element, shared: list[str], kinds: list[str | None], since_1904: bool) -> tuple[str | None, bool]:
    """Text of a cell, and whether it is a date."""
    v, kind = c.find(_NS + "v"), c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_NS + "t")), False
    if v is None or v.text is None:
        return None, False
    if kind == "s":
        return shared[int(v.text)], False
    if kind == "b":
        return ("True" if v.text == "1" else "False"), False
    if kind == "d":
        return v.text.replace("T", " "), True
    style = int(c.get("s", 0))
    shows = kinds[style] if kind in (None, "n") and style < len(kinds) else None
    if shows:
        text = from_serial(float(v.text), shows, since_1904)
        if text is not None:
            return text, shows == "date" or "-" in text
    return v.text, False


def _packed(path: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_())]
    block: list = []
    for row in rows:
        block.append((path, *row))
        if len(block) == ROWS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], [x.split()[0] for x in CELLS.split(", ")])
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], [x.split()[0] for x in CELLS.split(", ")])


def read_cells(spark: SparkSession, path: str | list[str], sheet: str | int = 0) -> DataFrame:
    """(path, sheet, row_no, cells, stamped) of one sheet of every workbook under ``path``, or of the named files."""
    ship(spark)
    first = path if isinstance(path, str) else path[0]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                store, inside = locate(p)
                with store.open_input_file(inside) as f:
                    yield from _packed(p, workbook_rows(f, sheet))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _packed(p, workbook_rows(io.BytesIO(memoryview(content.as_buffer())), sheet))

    if reachable(first):
        files = local_table(spark, [(p,) for p in path], "path string") if isinstance(path, list) else list_files(spark, path).where(F.lower("path").endswith(".xlsx")).select("path")
        return one_each(files).mapInArrow(streamed, CELLS)
    # a store that only Spark reads: a workbook is one cell there
    names = [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in path] if isinstance(path, list) else path
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(names).select("path", "content")
    return files.mapInArrow(in_cells, CELLS)


def read_workbooks(spark: SparkSession, path: str | list[str], sheet: str | int = 0, infer: bool = True, **_) -> DataFrame:
    """One table from all workbooks: the first row of each is the header (and must agree).

    A column whose filled cells are all dates is a timestamp; dates beside other values are ISO text.
    """
    cells = checkpoint_cut(read_cells(spark, path, sheet))
    firsts = cells.groupBy("path").agg(F.min("row_no").alias("_head"), F.min_by("cells", "row_no").alias("_names"))
    heads = [r[0] for r in firsts.select("_names").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"workbooks under '{path}' have {'different headers' if heads else 'no rows'}")
    names = [n if n is not None else f"Unnamed: {i}" for i, n in enumerate(heads[0])]
    rows = cells.join(F.broadcast(firsts.select("path", "_head")), "path").where(F.col("row_no") > F.col("_head"))
    own = [na_to_null(F.get("cells", F.lit(i))) for i in range(len(names))]
    kinds = rows.agg(*[F.bool_and(F.when(c.isNotNull(), F.get("stamped", F.lit(i)))).alias(f"k{i}") for i, c in enumerate(own)]).first() if infer else [None] * len(names)
    table = rows.select(F.col("path").alias("_file"), "row_no", *[(c.try_cast("timestamp") if k else c).alias(n) for c, k, n in zip(own, kinds, names)])
    filled = F.lit(False)
    for n in names:
        filled = filled | q(n).isNotNull()
    table = with_row_ids(table.where(filled).sortWithinPartitions("_file", "row_no").drop("row_no"), ["_file"], ROW_ID)
    return to_physical_types(table) if infer else table


# --- writing --------------------------------------------------------------------

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf numFmtId="0"/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0" xfId="0"/><xf numFmtId="22" xfId="0" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
#: Rows that a sheet holds, its header included.
SHEET_ROWS = 1_048_576


def _written(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (date, datetime)):
        at = v.replace(tzinfo=None) if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
        return f'<c s="1"><v>{(at - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    text = re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", str(v))  # what XML cannot hold
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbooks(df: DataFrame, path: str) -> DataFrame:
    """Write every partition as one or more workbooks under ``path``; (path, n) of those written.

    A task that runs again overwrites its own files.  ``path`` is in a store that pyarrow opens.
    """
    spark = df.sparkSession
    ship(spark)
    header = df.columns

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        task, number, row = TaskContext.get().partitionId(), 0, next(rows, None)
        store, inside = locate(path)
        store.create_dir(inside, recursive=True)
        while row is not None:
            name = f"{inside}/part-{task:05d}-{number:03d}.xlsx"
            n = 0
            with store.open_output_stream(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for part, text in _PARTS.items():
                    z.writestr(part, text)
                with z.open("xl/worksheets/sheet1.xml", "w") as out:
                    put: Callable[[str], int] = lambda text: out.write(text.encode())
                    put(f'<worksheet xmlns="{_NS[1:-1]}"><sheetData><row>{"".join(map(_written, header))}</row>')
                    while row is not None and n < SHEET_ROWS - 1:
                        put(f'<row>{"".join(map(_written, row))}</row>')
                        n, row = n + 1, next(rows, None)
                    put("</sheetData></worksheet>")
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "n"])

    return checkpoint_cut(df.mapInArrow(save, "path string, n long"))
