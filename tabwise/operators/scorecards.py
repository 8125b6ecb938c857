"""Scorecards: predictions of the analysis against expectation tables.

All functions take tables keyed by (dataset, column) or (dataset), so that a whole suite
of datasets is scored in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwise.functions import fixed as V
from tabwise.operators.claims import neighbours


def _score(ok, n, empty: float = 1.0):
    return F.round(F.coalesce(F.try_divide(ok.cast("double"), n.cast("double")), F.lit(empty)), 4)


def semantic_score(profile: DataFrame, expected: DataFrame) -> DataFrame:
    """Per dataset: accuracy, macro accuracy by class, low-confidence count.

    ``expected(dataset, column, labels array)``: a prediction matches a label that equals,
    contains or is contained in it; the first label names the class.
    """
    p = profile.select("dataset", F.trim("name").alias("column"), F.lower("semantic_label").alias("label"), "confidence")
    e = expected.select("dataset", F.trim("column").alias("column"), F.transform("labels", F.lower).alias("labels"))
    match = F.exists("labels", lambda x: F.contains(x, F.col("label")) | F.contains(F.col("label"), x))
    j = e.join(p, ["dataset", "column"], "left").select(
        "dataset", F.get("labels", F.lit(0)).alias("class"), F.col("label").isNotNull().alias("present"),
        F.coalesce(match, F.lit(False)).cast("int").alias("hit"), (F.col("confidence") < 0.70).alias("low"),
    )
    per_class = j.where("present").groupBy("dataset", "class").agg(F.avg("hit").alias("acc"))
    macro = per_class.groupBy("dataset").agg(F.round(F.avg("acc"), 4).alias("macro_accuracy"))
    flat = j.groupBy("dataset").agg(
        F.round(F.avg("hit"), 4).alias("accuracy"), F.sum("hit").alias("correct"), F.count("*").alias("total"),
        F.count_if("low").alias("low_confidence_count"),
    )
    return flat.join(macro, "dataset", "left").withColumn("macro_accuracy", F.coalesce("macro_accuracy", F.lit(1.0)))


def domain_score(domains: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, accuracy): 1 where the domain is the expected one."""
    return expected.select("dataset", F.lower("domain").alias("want")).join(
        domains.select("dataset", F.lower("domain").alias("got")), "dataset", "left"
    ).select("dataset", F.when(F.col("want") == F.col("got"), 1.0).otherwise(0.0).alias("accuracy"))


def date_score(dates: DataFrame, expected: DataFrame) -> DataFrame:
    """Per dataset: accuracy, ambiguous dates flagged, silent guesses, columns evaluated.

    ``expected(dataset, column, format, ambiguous)``; separators do not matter.
    """
    def norm(c):
        return F.upper(F.regexp_replace(c, "[/.]", "-"))

    j = expected.select("dataset", "column", F.col("format").alias("want"), "ambiguous").join(
        dates.select("dataset", "column", "detected_format", "needs_confirmation"), ["dataset", "column"], "left"
    )
    seen = F.col("detected_format").isNotNull()
    flagged = F.coalesce(F.col("ambiguous") & (F.col("detected_format") == "ambiguous") & F.col("needs_confirmation"), F.lit(False))
    silent = F.col("ambiguous") & seen & ~flagged
    right = flagged | (~F.col("ambiguous") & seen & (F.col("want").isNull() | (norm(F.col("detected_format")) == norm(F.col("want")))))
    return j.groupBy("dataset").agg(
        F.round(F.avg(right.cast("int")), 4).alias("accuracy"), F.count_if(flagged).alias("ambiguous_flagged"),
        F.count_if(silent).alias("silent_guesses"), F.count("*").alias("evaluated"),
    )


def pii_score(profile: DataFrame, expected: DataFrame) -> DataFrame:
    """Per dataset: TP, FN, FP, recall, precision from a full outer join of column sets."""
    got = profile.where("is_pii").select("dataset", F.col("name").alias("column"), F.lit(1).alias("got"))
    want = expected.where("is_pii").select("dataset", "column", F.lit(1).alias("want"))
    every = expected.select("dataset").union(profile.select("dataset")).distinct()
    j = got.join(want, ["dataset", "column"], "full_outer").groupBy("dataset").agg(
        F.count_if(F.col("got").isNotNull() & F.col("want").isNotNull()).alias("tp"),
        F.count_if(F.col("got").isNull()).alias("fn"), F.count_if(F.col("want").isNull()).alias("fp"),
    )
    j = every.join(j, "dataset", "left").fillna(0, ["tp", "fn", "fp"])
    return j.select(
        "dataset", "tp", "fn", "fp", _score(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _score(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def cleaning_score(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per dataset: share of four met expectations (rows before/after, duplicates, missing after)."""
    checks = ["rows_before", "rows_after", "duplicates_removed", "missing_after"]
    j = expected.select("dataset", *[F.col(c).alias("want_" + c) for c in checks]).join(actual, "dataset", "left")
    met = sum((F.coalesce((F.col(c) == F.col("want_" + c)).cast("int"), F.lit(0)) for c in checks), F.lit(0))
    return j.select("dataset", met.alias("met"), F.round(met / F.lit(4.0), 4).alias("accuracy"), (met == 4).alias("passed"))


def statistics_score(stats: DataFrame, expected: DataFrame, analysed: DataFrame, hidden: DataFrame, charts_ok: DataFrame | None = None) -> DataFrame:
    """Per dataset: statistics within max(1 %, 0.05), plus one point for hidden columns.

    stats(dataset, column, stat, value); expected(dataset, column, stat, expected);
    analysed(dataset, column) were correlated; hidden(dataset, column) must not be;
    charts_ok(dataset, ok) adds the chart point (taken as met where not given).
    """
    ok = F.abs(F.col("value") - F.col("expected")) <= F.greatest(F.lit(0.01) * F.abs("expected"), F.lit(0.05))
    # isclose semantics: the default relative tolerance is far below one percent
    facts = expected.join(stats, ["dataset", "column", "stat"], "left").groupBy("dataset").agg(
        F.count("*").alias("stats_total"), F.count_if(F.coalesce(ok, F.lit(False))).alias("stats_verified")
    )
    leaks = hidden.join(analysed, ["dataset", "column"], "left_semi").groupBy("dataset").agg(F.count("*").alias("leaks"))
    out = facts.join(leaks, "dataset", "left").withColumn("pii_excluded", F.coalesce("leaks", F.lit(0)) == 0)
    if charts_ok is None:
        out = out.withColumn("charts_ok", F.lit(True))
    else:
        out = out.join(charts_ok.select("dataset", F.col("ok").alias("charts_ok")), "dataset", "left")
    got = F.col("stats_verified") + F.col("pii_excluded").cast("int") + F.coalesce(F.col("charts_ok"), F.lit(False)).cast("int")
    return out.select("dataset", "stats_verified", "stats_total", "pii_excluded", F.round(got / (F.col("stats_total") + 2), 4).alias("accuracy"))


def model_score(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per dataset: five points (ran, target, task, metrics, saved), or 1/0 for a due skip.

    runs(dataset, status, target, task, metrics map, saved); expected(dataset, applicable, target, task).
    """
    e = expected.select("dataset", "applicable", F.col("target").alias("want_target"), F.col("task").alias("want_task"))
    ran = F.coalesce(F.col("status").isin("trained", "completed"), F.lit(False))
    points = (
        ran.cast("int") + F.coalesce((F.col("target") == F.col("want_target")).cast("int"), F.lit(0))
        + F.coalesce((F.col("task") == F.col("want_task")).cast("int"), F.lit(0))
        + F.coalesce((F.size("metrics") > 0).cast("int"), F.lit(0)) + F.coalesce(F.col("saved").cast("int"), F.lit(0))
    )
    return e.join(runs, "dataset", "left").select(
        "dataset", F.when(~F.col("applicable"), F.when(ran, 0.0).otherwise(1.0)).otherwise(F.round(points / 5.0, 4)).alias("score"),
        F.when(~F.col("applicable") & ~ran, "SKIPPED_INSUFFICIENT_DATA").when(~F.col("applicable"), "FAILED").when(ran, "TRAINED").otherwise("FAILED").alias("status"),
    )


def claim_score(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Per dataset: supported, unsupported and fabricated counts, grounding accuracy.

    Another test than ``ground_claims``: facts rounded to two decimals, 5 % of the larger
    of number, fact and 1, and the numbers 1, 2, 3 are skipped.  Facts of one dataset are
    the numbers of its catalogue; they travel as one sorted array per dataset, and the search
    takes as many steps as the longest array needs.
    """
    facts = known.select("dataset", F.round("value", 2).alias("v")).distinct().groupBy("dataset").agg(F.array_sort(F.collect_list("v")).alias("facts"))
    longest = facts.agg(F.max(F.size("facts"))).first()[0] or 1
    text = F.regexp_replace("text", V.SCALE_SUFFIX, "")
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b\d+(?:\.\d+)?\b"), 0)
    nums = F.filter(F.transform(found, lambda m: F.round(m.try_cast("double"), 2)), lambda x: x.isNotNull() & ~x.isin(1.0, 2.0, 3.0))

    def known_near(x):
        return F.exists(
            neighbours(F.col("facts"), x, longest),
            lambda f: F.abs(x - f) <= F.lit(0.05) * F.greatest(F.abs(x), F.abs(f), F.lit(1.0)),
        )

    empty = F.array().cast("array<double>")
    j = claims.join(facts, "dataset", "left").withColumn("facts", F.coalesce("facts", empty))
    j = j.withColumn("made_up", F.size(F.filter(nums, lambda x: ~known_near(x))))
    good = (F.col("made_up") == 0) & F.coalesce(F.col("evidence") != "", F.lit(False))
    out = j.groupBy("dataset").agg(
        F.count_if(good).alias("supported"), F.count_if(~good).alias("unsupported"), F.sum("made_up").alias("fabricated"), F.count("*").alias("claims")
    )
    return out.withColumn("accuracy", _score(F.col("supported"), F.col("supported") + F.col("unsupported") + F.col("fabricated")))


def stage_runtimes(metrics: DataFrame, stages: list[str]) -> DataFrame:
    """(run_id, one column per stage, total): seconds per stage of each run; the total is over all of its stages."""
    each = [F.sum(F.when(F.col("stage") == s, F.col("seconds"))).alias(s) for s in stages]
    return metrics.groupBy("run_id").agg(*each, F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 4).alias("total"))


def suite_means(scores: DataFrame) -> DataFrame:
    """(evaluator, datasets, mean_score) over a long table (dataset, evaluator, score)."""
    return scores.groupBy("evaluator").agg(F.count_distinct("dataset").alias("datasets"), F.round(F.avg("score"), 4).alias("mean_score"))

