"""Delimited text: inspection, audit, reading with pandas-like row and null rules."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import na_to_null, q
from tabwise.operators.profile import ROW_ID
from tabwise.session import checkpoint_cut
from tabwise.sources.rowid import with_row_ids
from tabwise.sources.scan import list_files, scan_files, signature
from tabwise.sources.typing import to_physical_types
from tabwise.sources.workbook import read_workbooks

HEAD_LINES = 50
#: Bytes of a line that Spark's text readers can hold.
MOST_LINE = 1 << 30
CHARSET = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


def inspect_text(spark: SparkSession, path: str | list[str], lines: int = HEAD_LINES) -> DataFrame:
    """(path, encoding, delimiter, quoted_breaks, header): one scan over a file or folder, one row per file with text.

    Encoding: utf-8 where every line is valid, else latin-1.  Delimiter: among the four
    candidates the one that occurs equally often (and at all) in most of the first lines.
    Quoted breaks: some line has an odd number of quotes, so a field goes on in the next line.
    Header: digest of the first line that is not blank.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"),
    )
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    encodings = raw.groupBy("path").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "utf-8").otherwise("latin-1").alias("encoding"),
        F.bool_or(quotes % 2 == 1).alias("quoted_breaks"),
    )
    first = Window.partitionBy("path").orderBy("at")
    head = (
        raw.where("block = 0 and trim(value) <> ''")
        .withColumn("k", F.row_number().over(first)).where(F.col("k") <= lines)
        .select("path", "k", F.md5(F.col("value").cast("binary")).alias("digest"), F.regexp_replace("value", '"[^"]*"', "").alias("line"))
    )
    headers = head.where("k = 1").select("path", F.col("digest").alias("header"))
    counted = head.select("path", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), (F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))).alias("n"))
        for i, d in enumerate(V.DELIMITERS)
    ])).alias("e")).select("path", "e.*")
    per_count = counted.where("n > 0").groupBy("path", "i", "d", "n").agg(F.count("*").alias("lines"))
    best = per_count.groupBy("path").agg(
        F.max_by("d", F.struct("lines", "n", -F.col("i"))).alias("delimiter")
    )
    return encodings.join(headers, "path").join(best, "path", "left").select(
        "path", "encoding", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), "quoted_breaks", "header"
    )


def _literal(path: str) -> str:
    """A path whose signs do not count as wildcards."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def read_delimited(
    spark: SparkSession, path: str | list[str], delimiter: str | None = None, encoding: str | None = None, multi_line: bool | None = None,
    infer: bool = True, row_ids: bool = True, trim_headers: bool = False,
) -> DataFrame:
    """A delimited file or folder as a table.

    Every file is read in its own dialect: files are grouped by delimiter, encoding, header and
    quoted line breaks, and the groups are put together by column name (a column that a file
    lacks is NULL there).  Arguments that are given hold for all files; with all three given,
    all files have the header of the first.  A file with quoted line breaks cannot be split and
    is one task's work.

    Rows with too many fields are dropped, short rows are filled with NULL, missing-value
    tokens become NULL, and columns get a physical type only where every value fits it.
    """
    given = {"delimiter": delimiter, "encoding": encoding, "quoted_breaks": multi_line}
    if None in given.values():
        seen = inspect_text(spark, path).withColumns({k: F.lit(v) for k, v in given.items() if v is not None})
        dialect = [*given, "header"]
        groups = seen.groupBy(*dialect).agg(F.array_sort(F.collect_list("path")).alias("paths")).drop("header").collect()
        if not groups:
            raise ValueError(f"nothing to read under '{path}'")
        if len(groups) == 1:
            groups = [groups[0].asDict() | {"paths": path}]
        else:
            groups = [g.asDict() | {"paths": [_literal(unquote(p)) for p in g.paths]} for g in sorted(groups, key=lambda g: g.paths[0])]
    else:
        groups = [given | {"paths": path}]
    parts = [_read_group(spark, g["paths"], g["delimiter"], g["encoding"], g["quoted_breaks"], trim_headers) for g in groups]
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    table = with_row_ids(table, ["_file", "_block"]) if row_ids else table.drop("_file", "_block")
    return to_physical_types(table) if infer else table


def _read_group(spark: SparkSession, paths: str | list[str], delimiter: str, encoding: str, multi_line: bool, trim_headers: bool) -> DataFrame:
    """Files of one dialect as text columns, with ``_file`` and ``_block``."""
    base = {
        "sep": delimiter, "encoding": CHARSET.get(encoding, encoding), "quote": '"', "escape": '"',
        "multiLine": str(multi_line).lower(), "header": "true",
    }
    names = [n.lstrip("\ufeff") for n in spark.read.options(**base).csv(paths).columns]
    cols = [n.strip() if trim_headers else n for n in names]
    schema = ", ".join(f"c{i} string" for i in range(len(cols))) + ", _corrupt string"
    # Rows with too few or too many fields come with their raw text; only the latter are
    # dropped, told apart by their separators outside quotes.  Pruning stays off because it
    # would change which rows count as malformed.
    raw = spark.read.options(
        **base, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", columnPruning="false"
    ).schema(schema).csv(paths)
    bare = F.regexp_replace("_corrupt", '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    kept = raw.where(F.col("_corrupt").isNull() | (fields <= len(cols)))
    return kept.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        *[na_to_null(F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)],
    )


def _error(cond, text):
    return F.when(cond, F.lit(text) if isinstance(text, str) else text)


def audit_files(spark: SparkSession, path: str, max_mb: int | None = None) -> DataFrame:
    """(path, file_type, bytes, megabytes, sha256, encoding, is_valid, errors) of every file under a landing zone.

    Size and extension are judged on the listing alone; files above ``max_mb`` are not opened.  Every other file is
    read once, as a stream, by one task: digest, encoding, signature and lines are those of the whole file.
    """
    cap = (1 << 62) if max_mb is None else max_mb * 1024 * 1024
    meta = checkpoint_cut(list_files(spark, path)).withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    facts = scan_files(spark, path, meta.where((F.col("bytes") <= cap) & (F.col("bytes") > 0))).withColumn("signature", signature(F.col("head")))
    csv, xlsx = F.col("ext") == ".csv", F.col("ext") == ".xlsx"
    zipped = F.hex("head").startswith(V.ZIP_SIGNATURE)
    sized = (F.col("bytes") > 0) & (F.col("bytes") <= cap)
    ok_meta = sized & F.col("opened")
    plain = ok_meta & csv & F.col("signature").isNull()
    errors = F.array(
        _error(F.col("bytes") == 0, V.AUDIT["empty"]),
        _error(F.col("bytes") > cap, V.AUDIT["large"].format(max_mb)),
        _error(sized & (F.col("ext") == ".xls"), V.AUDIT["legacy"]),
        _error(sized & ~csv & ~xlsx & (F.col("ext") != ".xls"), F.format_string(V.AUDIT["extension"], F.col("ext"))),
        _error(sized & (csv | xlsx) & ~F.col("opened"), "File is too large for the only reader that can open it."),
        _error(ok_meta & xlsx & ~zipped, V.AUDIT["not_zip"]),
        _error(ok_meta & xlsx & zipped & ~F.col("has_directory"), V.AUDIT["broken_zip"]),
        _error(ok_meta & xlsx & zipped & F.col("has_directory") & ~F.col("has_parts"), V.AUDIT["no_parts"]),
        _error(ok_meta & csv & F.col("signature").isNotNull(), F.format_string(V.AUDIT["signature"], F.col("signature"))),
        _error(plain & (F.col("n_lines") == 0), V.AUDIT["no_text"]),
        _error(plain & (F.col("n_lines") > 0) & ~F.col("has_text"), V.AUDIT["no_rows"]),
        _error(plain & F.col("has_text") & (F.col("n_lines") < 2), V.AUDIT["header_only"]),
        _error(plain & (F.col("longest_line") > MOST_LINE), f"Dataset has a line of more than {MOST_LINE} bytes."),
    )
    return (
        meta.join(facts, "path", "left")
        .withColumn("errors", F.array_compact(errors))
        .select(
            "path", F.when(csv, "csv").when(xlsx, "xlsx").otherwise("").alias("file_type"), "bytes", F.round(F.col("bytes") / 1048576.0, 2).alias("megabytes"),
            "sha256", F.when(csv, F.when(F.col("utf8"), "utf-8").when(~F.col("utf8"), "latin-1")).alias("encoding"), (F.size("errors") == 0).alias("is_valid"), "errors",
        )
    )


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every file under a folder; file contents are not read."""
    return list_files(spark, path).orderBy("path")


def ingest(spark: SparkSession, path: str, max_mb: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(table with row ids, ingestion facts) of a file or folder of delimited files, workbooks, or both.

    Files that fail the audit are left out; the facts name them with their errors.  Delimited files and workbooks are
    put together by column name, delimited files first.  Refuses a path without a valid file and tables without rows.
    """
    audit = checkpoint_cut(audit_files(spark, path, max_mb))
    counts = {r.file_type: (r.good, r.n) for r in audit.groupBy("file_type").agg(F.count_if("is_valid").alias("good"), F.count("*").alias("n")).collect()}
    kinds = sorted(k for k, (good, _) in counts.items() if good)
    if not kinds:
        bad = audit.where("not is_valid").orderBy("path").first()
        raise ValueError(f"File validation failed for '{bad['path']}': {'; '.join(bad['errors'])}" if bad else f"no file under '{path}'")
    whole = all(good == n for good, n in counts.values())

    def paths(kind: str) -> str | list[str]:
        # the path itself where all of it is read; else the valid files of a kind by name
        if whole and len(kinds) == 1:
            return path
        names = [r[0] for r in audit.where(F.col("is_valid") & (F.col("file_type") == kind)).select("path").orderBy("path").collect()]
        return [_literal(n) for n in names] if kind == "csv" else names

    if kinds == ["xlsx"]:
        table = read_workbooks(spark, paths("xlsx"), **options)
    elif kinds == ["csv"]:
        table = read_delimited(spark, paths("csv"), **options)
    else:
        own = {k: v for k, v in options.items() if k != "infer"}
        # text first: a column's type is decided over files of both kinds
        parts = [(0, read_delimited(spark, paths("csv"), infer=False, **own)), (1, read_workbooks(spark, paths("xlsx"), infer=False, **own))]
        a, b = (t.withColumnRenamed(ROW_ID, "_at").withColumn("_part", F.lit(k)) for k, t in parts)
        first = parts[0][1].count()
        both = a.unionByName(b, allowMissingColumns=True)
        table = both.select((F.col("_at") + F.lit(first) * F.col("_part")).alias(ROW_ID), *[q(c) for c in both.columns if c not in ("_at", "_part")])
        table = to_physical_types(table) if options.get("infer", True) else table
    n = table.count()
    if n == 0:
        raise ValueError(f"Dataset '{path}' contains zero data rows after parsing.")
    facts = audit.select("path", "file_type", "bytes", "sha256", "encoding", "is_valid", "errors").withColumns(
        {"n_rows": F.lit(n), "n_columns": F.lit(len(table.columns) - 1)}
    )
    return table, facts
