"""Writing cleaned tables, sidecars and fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwise.operators.clean import Cleaned


def write_cleaned(cleaned: Cleaned, folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Cleaned table, removed rows and sidecars under one folder: {name: path}.

    Formats that cannot be split or typed (csv) are for exchange; sidecars stay Parquet.
    """
    paths = {}
    tables = {"cleaned": cleaned.table, "removed_rows": cleaned.removed}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        out = df.write.mode("overwrite")
        if fmt == "csv":
            out.option("header", "true").csv(paths[name])
        else:
            out.format(fmt).save(paths[name])
    for name, df in {"null_cells": cleaned.null_cells, "raw_cells": cleaned.raw_cells, "outlier_cells": cleaned.outliers, "cleaning_log": cleaned.log}.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def save_facts(tables: dict[str, DataFrame], folder: str) -> None:
    """Fact tables as Parquet; the commit protocol makes each table appear whole or not at all."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_facts(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def to_json_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON document per row, for exchange."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_json_lines(lines: DataFrame, schema) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def partition_runs(df: DataFrame, folder: str, run: str = "run_id") -> None:
    """Append run facts partitioned by run, so that one run is read without the others."""
    df.write.mode("append").partitionBy(run).parquet(folder)

