"""The whole analysis of one table: profile, clean, summarise, model, explain."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabwise.operators import charts, clean as K, dates as D, insights as I, models as M, profile as P, stats as S
from tabwise.operators.profile import ROW_ID
from tabwise.session import checkpoint_cut, local_table, settle

MODEL_FACTS = (
    "status string, task string, target string, selected_model string, metrics map<string,double>, "
    "improved_over_baseline boolean, train_rows long, test_rows long, reason string"
)


@dataclass
class Analysis:
    """Everything one run produces."""

    facts: I.Facts
    cleaned: K.Cleaned
    table: DataFrame
    top_pairs: DataFrame
    chart_plan: DataFrame
    insights: DataFrame
    model: dict
    runtimes: dict[str, float] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def payload(self) -> DataFrame:
        return I.report_payload(self.facts, self.insights)

    def context(self, max_tokens: int = 1200) -> DataFrame:
        return I.chat_context(self.facts, self.insights, max_tokens)

    def fact_base(self) -> DataFrame:
        return I.fact_base(self.facts)


def analyse(
    df: DataFrame, dataset_id: str, preferred_target: str | None = None, train: bool = True, sample_rows: bool = False,
    max_insights: int = 10, max_charts: int = 6, trees: int = M.TREES, rounds: int = 100,
) -> Analysis:
    """Analyse a table that carries ``_row_id``.

    The input and the cleaned table are staged once each; every other table that is kept
    between steps has about one row per column.  Loading and cleaning must succeed, the
    later steps may fail and are then reported in ``errors``.
    """
    spark = df.sparkSession
    took: dict[str, float] = {}
    errors: dict[str, str] = {}
    t0 = time.time()

    def lap(stage: str) -> None:
        nonlocal t0
        took[stage], t0 = round(time.time() - t0, 4), time.time()

    counts = checkpoint_cut(P.value_counts(df))
    profile = settle(P.profile_columns(df, sample_rows=sample_rows, counts=counts))
    dates = settle(D.resolve_dates(df, counts=counts, sample_rows=sample_rows))
    duplicates = settle(P.duplicate_rate(df))
    quality = settle(P.quality_score(profile, dates, duplicates))
    issues = settle(P.quality_issues(profile, dates, duplicates))
    domain = settle(P.classify_domain(profile))
    lap("intelligence")

    cleaned = K.clean(df, profile, dates)
    table = checkpoint_cut(cleaned.table)
    cleaned.table = table
    lap("cleaning")

    prof = profile.collect()
    numeric, categorical = (settle(x) for x in S.dataset_summary(table, prof))
    names = S.eligible_numeric(table, prof)
    pearson = settle(S.pearson_pairs(table, names))
    spearman = settle(S.spearman_pairs(table, names))
    top = S.top_pairs(pearson)
    best = top.first()
    plan = charts.chart_plan(table, prof, dates.collect(), (best["col1"], best["col2"]) if best else None, max_charts)
    lap("eda")

    model: dict = {"status": "skipped", "reason": "not requested"}
    if train:
        try:
            model = M.model_status(table, profile, ROW_ID, preferred_target, trees=trees, rounds=rounds)
        except Exception as e:  # a failed fit must not lose the other results
            errors["ml"] = str(e)
            model = {"status": "failed", "reason": str(e)}
    row = {k: model.get(k) for k in ("status", "task", "target", "selected_model", "metrics", "improved_over_baseline", "train_rows", "test_rows", "reason")}
    model_facts = local_table(spark, [tuple(row.values())], MODEL_FACTS)
    importance = model.get("importance")
    if importance is None:
        importance = local_table(spark, [], "feature string, importance double")
    lap("ml")

    shape = local_table(spark, [(prof[0]["n_rows"] if prof else 0, len(prof))], "n_rows long, n_columns int")
    facts = I.Facts(
        dataset_id, profile, shape, quality, issues, domain, dates, numeric, categorical, pearson, spearman, model_facts,
        settle(importance), cleaned.log,
    )
    insights = settle(I.rule_insights(facts, max_insights))
    lap("insight")
    return Analysis(facts, cleaned, table, top, plan, insights, model, took, errors)


def run_metrics(analysis: Analysis, run_id: str) -> DataFrame:
    """(run_id, stage, seconds, status) of a finished run."""
    rows = [(run_id, s, t, "failed" if s in analysis.errors else "finished") for s, t in analysis.runtimes.items()]
    df = local_table(analysis.table.sparkSession, rows, "run_id string, stage string, seconds double, status string")
    return df.withColumn("created_at", F.current_timestamp())
