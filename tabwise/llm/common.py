"""What the operators of this folder share: Arrow maps over whole texts and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

SPACES = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exact_names(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of a function that plans on a DataFrame: columns whose names differ in case only are told apart meanwhile."""
    @wraps(build)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        spark = docs.sparkSession
        before = spark.conf.get("spark.sql.caseSensitive")
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            return build(docs, *args, **options)
        finally:
            spark.conf.set("spark.sql.caseSensitive", before)

    return run


@exact_names
def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns."""
    ship(docs.sparkSession)
    return docs.select(*(F.col(f"`{n}`") for n in names))


def map_rows(docs: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Run a function on every row, one Arrow batch at a time.

    ``start`` is called once in each task and returns a function of one row's values that
    yields result rows.  Results are sent on in pieces, so a task holds one batch at a time.
    """
    st = T.StructType.fromDDL(schema)
    arrow, width = to_arrow_schema(st), len(st.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                out.extend(work(*row))
                if len(out) >= 50_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * width
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, st)


def _text_at(docs: DataFrame, text_col: str) -> int:
    if text_col not in docs.columns:
        raise ValueError(f"no column {text_col}")
    return docs.columns.index(text_col)


@exact_names
def keep_rows(docs: DataFrame, text_col: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows whose text a function of a list of texts says to keep, with all of their columns, without a shuffle."""
    ship(docs.sparkSession)
    at = _text_at(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = start()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield part.filter(pa.array(judge(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@exact_names
def replace_text(docs: DataFrame, text_col: str, start: Callable[[], Callable[[str], str]]) -> DataFrame:
    """All rows and columns, the text (null stays null) put through a function."""
    ship(docs.sparkSession)
    at = _text_at(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in batches:
            old = batch.column(at)
            new = pa.array([None if t is None else change(t) for t in old.to_pylist()], old.type)
            columns = list(batch.columns)
            columns[at] = new
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir; a temporary one on one machine only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors never cost its history."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
