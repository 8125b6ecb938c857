"""A training corpus from documents: stages in order, each an operator of tabwise.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwise.llm import decontaminate, mixture, secrets, simhash, toxicity
from tabwise.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject.

    Null and empty texts score as an empty window; with too few labels to learn from, and in an empty table, all stay.
    Equal rows are judged alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null, empty and wordless texts are one group.  Of rows with one id and text one stays; a null id comes last."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, changed parameters included.

    Null and empty texts hold none; null and empty items are held by none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text.

    A null text stays null, and so does its length."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for every copy that is taken, with its output shard and place.

    Null texts have no words, and a source without words is not taken; a null source is a source of its own, the last."""
    return mixture.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("source_mixture", mix_sources),
]

#: SQL can neither train nor run the models of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_function in STAGES[:-1]:
        docs = stage(stage_function(spark, docs, sf_dir), f"pipeline-{name}")
    return stage(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
