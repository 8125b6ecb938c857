"""Run catalogue, usage ledger and metadata checks over run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabwise.functions.exprs import q
from tabwise.session import local_table


def newest_runs(runs: DataFrame, n: int = 50, status: str | None = None) -> DataFrame:
    """Newest runs first, optionally of one status (pushed to the scan)."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "run_id").limit(n)


def status_summary(runs: DataFrame) -> DataFrame:
    """(status, runs, mean_seconds)."""
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))


def usage_ledger(calls: DataFrame, budget: int, run: str = "run_id", call: str = "call_no", tokens: str = "tokens", chunk: int = 100_000) -> DataFrame:
    """Add cumulative tokens per run, what is left, and whether the call went past the budget.

    A run with very many calls is first summed in blocks of call numbers; running sums
    inside blocks and over blocks replace one long window per run.
    """
    block = F.floor(q(call) / F.lit(chunk))
    rows = calls.withColumn("_block", block)
    sums = rows.groupBy(run, "_block").agg(F.sum(tokens).alias("_sum"))
    w = Window.partitionBy(run).orderBy("_block")
    starts = sums.select(run, "_block", (F.sum("_sum").over(w) - F.col("_sum")).alias("_start"))
    inside = Window.partitionBy(run, "_block").orderBy(call).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(starts, [run, "_block"])
        .withColumn("cumulative_tokens", F.col("_start") + F.sum(tokens).over(inside))
        .withColumn("remaining_tokens", F.greatest(F.lit(0), F.lit(budget) - F.col("cumulative_tokens")))
        .withColumn("past_budget", F.col("cumulative_tokens") > budget)
        .drop("_block", "_start")
    )


def budget_totals(calls: DataFrame, budget: int, run: str = "run_id", tokens: str = "tokens") -> DataFrame:
    """(run, calls, total_tokens, remaining_tokens, is_exhausted)."""
    total = F.sum(tokens)
    return calls.groupBy(run).agg(
        F.count("*").alias("calls"), total.alias("total_tokens"),
        F.greatest(F.lit(0), F.lit(budget) - total).alias("remaining_tokens"), (total >= budget).alias("is_exhausted"),
    )


REQUIRED = {
    "columns": ["ordinal", "name", "dtype_inferred", "semantic_label", "is_pii", "null_pct", "unique_count"],
    "date_columns": ["column", "detected_format", "confidence", "needs_confirmation"],
    "cleaning_log": ["step_no", "column", "method", "reason"],
    "numeric_stats": ["column", "mean", "std", "min", "max"],
}


def metadata_issues(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(section, issue): missing sections, missing fields, records without ids.

    ``ids(dataset_id, schema_version)`` is the run header.
    """
    spark = ids.sparkSession
    rows = []
    for section, fields in REQUIRED.items():
        if section not in tables:
            rows.append((section, f"'{section}' is missing"))
            continue
        rows += [(section, f"'{section}' lacks field '{f}'") for f in fields if f not in tables[section].columns]
    out = local_table(spark, rows, "section string, issue string")
    for c in ("schema_version", "dataset_id"):
        out = out.unionByName(
            ids.where(F.coalesce(F.trim(q(c).cast("string")), F.lit("")) == "").select(F.lit("header").alias("section"), F.lit(f"Missing '{c}'").alias("issue"))
        )
    if "columns" in tables and "name" in tables["columns"].columns:
        out = out.unionByName(tables["columns"].where("name is null or trim(name) = ''").select(F.lit("columns").alias("section"), F.lit("column without a name").alias("issue")))
    return out
