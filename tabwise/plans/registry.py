"""Registry of named queries with, where SQL can say the same, an equivalent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwise.session import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def query(sql: str | None = None):
    """Register a function under its own name."""
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A view text that both engines read: table names are bound to the folder's tables."""
    used = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    text = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON texts are not placeholders
    text = re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes: the cluster's shared folder where it names one."""
    return fresh_folder(spark, name)


def lit_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def first_match(rules: list[tuple[str, str]], column: str, otherwise: str = "NULL") -> str:
    """SQL CASE that names the first rule (name, pattern) a column matches."""
    arms = " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules)
    return f"CASE {arms} ELSE {otherwise} END"


def each(columns: list[str], template: str) -> str:
    """UNION ALL of a SQL template per column; ``{c}`` is the column."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)
