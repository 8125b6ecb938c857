"""Session helpers: a local builder for tests and a lineage cut for clusters."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def session(app: str = "tabwise", master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session.  Cluster settings stay with the cluster: only the
    options the library depends on (UTC dates, adaptive execution) are set here."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used before a table is read by several jobs, so that lost executors never force
    the whole history to run again.  The folder is the one the cluster names in
    ``spark.checkpoint.dir``; a temporary one is set only where none is named and all tasks
    run on this machine.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or local_folder(sc, "tabwise-checkpoint-"))
    return df.checkpoint(eager=True)


def local_folder(sc, prefix: str) -> str:
    """A temporary folder, for sessions on one machine only: executors elsewhere would not see it."""
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path for files that all executors share: beside the checkpoints where the cluster names a folder for them."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    base = shared.rstrip("/") if shared else local_folder(sc, "tabwise-")
    return f"{base}/tabwise-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``checkpoint_cut`` for tables of many rows: as Parquet, a fraction of the size, of which jobs read the columns they need."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """Few literal rows as a local relation: known size, no job and no Python when scanned."""
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in st.fields]
    dicts = [dict(zip(names, r)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(dicts, schema=to_arrow_schema(st)), st)


def settle(df: DataFrame) -> DataFrame:
    """Hold a fact table (about one row per column of the data) as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def once(df: DataFrame, value: Column) -> DataFrame:
    """Add the fields of a struct as columns that are computed exactly once per row.

    A one-element generator keeps the optimizer from copying a long expression into every
    later filter and projection that mentions its result.
    """
    return df.select("*", F.inline(F.array(value)))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application, so that their Python can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
