"""Listing of folders and reading of whole files as streams, in tasks and in constant memory.

A file is read chunk by chunk by the one task that has it, so its size does not matter.  Where Python
cannot open a path itself (wildcards, stores that only Spark's readers know), Spark's own listing and
binary reader take over; that reader holds a file in one cell and so ends at 2 GiB.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwise.functions import fixed as V
from tabwise.session import checkpoint_cut, local_table, ship

CHUNK = 4 << 20
#: Bytes of a file that Spark's binary reader can hold in a cell.
CELL = (1 << 31) - (1 << 20)
#: Schemes that pyarrow's file systems open, under the names they have there.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs"}
LISTING = "path string, bytes long, folder boolean"
FACTS = ("path string, opened boolean, sha256 string, head binary, utf8 boolean, n_lines long, longest_line long, has_text boolean, "
         "has_directory boolean, has_parts boolean")


def locate(path: str) -> tuple[arrow_fs.FileSystem, str] | None:
    """File system and path within it; None where pyarrow has none for the scheme."""
    parts = urlsplit(path)
    scheme = SCHEMES.get(parts.scheme)
    if scheme is None:
        return None
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), path if not parts.scheme else re.sub("^file:/+", "/", path)
    return arrow_fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}{parts.path}")


def reachable(path: str) -> bool:
    """Can Python open what lies there?"""
    try:
        found = locate(path)
        return found is not None and found[0].get_file_info(found[1]).type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory)
    except OSError:
        return False


def spelled(path: str, like: str) -> str:
    """A path within a file system as Spark's file sources spell it; ``like`` is a path of the same store."""
    scheme = urlsplit(like).scheme
    return f"file:{path}" if SCHEMES[scheme] == "file" else f"{scheme}://{path}"


def hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


# ---------------------------------------------------------------- listing


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every file under a path, empty ones included.

    Folders are listed by tasks, one job for each level of the tree; names and sizes stay on the
    executors.  Paths with wildcards and stores that pyarrow does not know are listed by Spark.
    """
    if not reachable(path):  # wildcards, or a store that only Spark reads
        return _listed_by_spark(spark, path)

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, inside = locate(folder)
                own = store.get_file_info(inside)
                infos = store.get_file_info(arrow_fs.FileSelector(inside)) if own.type == arrow_fs.FileType.Directory else [own]
                rows = [(spelled(i.path, folder), i.size or 0, i.type == arrow_fs.FileType.Directory) for i in infos if not hidden(i.base_name)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 10_000]), (pa.string(), pa.int64(), pa.bool_()))], ["path", "bytes", "folder"])

    ship(spark)
    level = local_table(spark, [(path,)], "path string")
    files = None
    while True:
        level = checkpoint_cut(level.mapInArrow(children, LISTING))
        own = level.where("not folder").select("path", "bytes")
        files = own if files is None else files.union(own)
        level = level.where("folder").select("path")
        if level.isEmpty():
            return files
        level = one_each(level)


def one_each(files: DataFrame, most: int = 10_000) -> DataFrame:
    """The (path, ...) rows in a task for each file.

    A number of parts is given because paths are short: parts of any other shuffle are merged into one task, which
    would read all files.
    """
    return files.repartitionByRange(min(max(files.count(), 1), most), "path")


def _as_column(listed: str) -> str:
    """A path of the driver's file listing as the file source spells it in its column."""
    return re.sub("^file:/+", "file:/", unquote(listed))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _listed_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """Empty files make no input split; they are known from the driver's file listing only."""
    listed = local_table(spark, [(_as_column(p),) for p in _binary(spark, path).inputFiles()], "path string")
    sizes = _binary(spark, path).select("path", F.col("length").alias("bytes"))
    return listed.join(sizes, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))


# ---------------------------------------------------------------- one file


class Lines:
    """Counts lines with more than spaces, and the longest line, over chunks of bytes."""

    def __init__(self):
        self.count = self.longest = self.open_bytes = 0
        self.open_text = False

    def feed(self, chunk: bytes) -> None:
        a = np.frombuffer(chunk, np.uint8)
        breaks = (a == 10) | (a == 13)
        at = np.flatnonzero(breaks)
        ends = np.r_[at, len(a)]
        lengths = np.diff(np.r_[-1, ends]) - 1
        lengths[0] += self.open_bytes
        self.longest = max(self.longest, int(lengths.max()))
        self.open_bytes = int(lengths[-1])
        # without spaces, a line counts where text follows a break
        text = ~breaks[a != 32]
        if len(text):
            self.count += int((text[1:] & ~text[:-1]).sum()) + int(text[0] and not self.open_text)
            self.open_text = bool(text[-1])


def scan_stream(f: BinaryIO, ext: str) -> tuple:
    """Facts of one file, read to its end in chunks: the columns of FACTS after ``opened``."""
    digest, head, lines = hashlib.sha256(), b"", Lines()
    decoder = codecs.getincrementaldecoder("utf-8")()
    utf8, text, csv = True, False, ext == ".csv"
    while chunk := f.read(CHUNK):
        digest.update(chunk)
        head += bytes(chunk[:8 - len(head)])
        if csv:
            lines.feed(chunk)
            text = text or bool(chunk.translate(None, b",;\t|\n\x0b\x0c\r "))
            if utf8:
                try:
                    decoder.decode(chunk)
                except UnicodeDecodeError:
                    utf8 = False
    if csv and utf8:
        try:
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            utf8 = False
    directory = parts = None
    if ext == ".xlsx":
        try:
            f.seek(0)
            names = zipfile.ZipFile(f).namelist()
            directory, parts = True, any(n == "[Content_Types].xml" or n.startswith("xl/") for n in names)
        except (zipfile.BadZipFile, OSError, ValueError):
            directory = False
    return digest.hexdigest(), head, utf8 if csv else None, lines.count if csv else None, lines.longest if csv else None, text if csv else None, directory, parts


def extension(path: str) -> str:
    found = re.search(r"(\.[^./]+)$", path)
    return found.group(1).lower() if found else ""


def _facts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.bool_(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in FACTS.split(", ")])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                store, inside = locate(path)
                with store.open_input_file(inside) as f:
                    yield _facts([(path, True, *scan_stream(f, extension(path)))])
            except (OSError, TypeError, pa.ArrowException):
                yield _facts([(path, False, *[None] * 8)])


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield _facts([(path, True, *scan_stream(io.BytesIO(memoryview(content.as_buffer())), extension(path)))])


def scan_files(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """FACTS of the listed files (path, bytes): one task reads a file from end to end in chunks.

    Files that Python cannot open are read by Spark's binary reader as far as it can hold them; of
    the others ``opened`` is false.
    """
    ship(spark)
    known = checkpoint_cut(one_each(listed.select("path")).mapInArrow(_streamed, FACTS))
    closed = known.where("not opened").select("path")
    if closed.isEmpty():
        return known
    cells = _binary(spark, path).where((F.col("length") <= CELL) & (F.col("length") > 0)).select("path", "content")
    read = cells.join(closed, "path", "left_semi").mapInArrow(_in_cells, FACTS)
    rest = known.where("not opened").join(listed.where(F.col("bytes") > CELL), "path", "left_semi")
    return known.where("opened").union(read).union(rest)


def signature(head: Column) -> Column:
    """Name of the binary format that a file's first bytes (a column) tell, else null."""
    found = F.lit(None).cast("string")
    for sign, what in reversed(V.FILE_SIGNATURES):
        found = F.when(F.hex(head).startswith(sign), what).otherwise(found)
    return found
