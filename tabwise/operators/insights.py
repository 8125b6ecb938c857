"""Fact base, evidence, rule insights, bounded context and report payload.

Inputs are the small fact tables of one dataset (column catalogue, statistics,
correlations, model outcome); none of these grows with the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import kept_out_of_evidence, numbers_in, shielded
from tabwise.operators.stats import NUMERIC_SUMMARY


@dataclass
class Facts:
    """The fact tables of one analysed dataset; ``model`` is empty where nothing was trained.

    shape: n_rows, n_columns; quality: score; issues: issue; domain: domain, confidence;
    model: status, task, target, selected_model, metrics map, train_rows, test_rows;
    importance: feature, importance.
    """

    dataset_id: str
    profile: DataFrame
    shape: DataFrame
    quality: DataFrame
    issues: DataFrame
    domain: DataFrame
    dates: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    pearson: DataFrame
    spearman: DataFrame
    model: DataFrame
    importance: DataFrame
    cleaning: DataFrame


def excluded_columns(profile: DataFrame) -> DataFrame:
    """(column) that may not appear in evidence."""
    return profile.where(
        kept_out_of_evidence(F.col("name"), F.col("is_pii"), F.col("semantic_label"), F.col("pii_type"))
    ).select(F.col("name").alias("column"))


def shielded_columns(profile: DataFrame) -> DataFrame:
    return profile.where(
        shielded(F.col("name"), F.col("is_pii"), F.col("semantic_label"), F.col("pii_type"))
    ).select(F.col("name").alias("column"))


def fact_base(f: Facts) -> DataFrame:
    """(dataset_id, path, value, is_int): every number a claim may cite, sensitive columns left out.

    Shares of categories count as fractions even where they are whole.
    """
    out = excluded_columns(f.profile)
    num = f.numeric.join(F.broadcast(out), "column", "left_anti")
    names = [c for c in NUMERIC_SUMMARY if c != "column"]
    stats = num.select("column", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("value")) for k in names])).alias("e")).select(
        F.concat_ws(".", F.lit("numeric"), "column", "e.k").alias("path"), "e.value"
    )
    cat = f.categorical.join(F.broadcast(out), "column", "left_anti")
    uniques = cat.select(F.concat_ws(".", F.lit("categorical"), "column", F.lit("unique_count")).alias("path"), F.col("unique_count").cast("double").alias("value"))
    rows = f.shape.select(F.col("n_rows").alias("_rows"))
    shares = cat.where("top_categories is not null").join(rows, how="cross").select(
        "column", "_rows", F.explode("top_categories").alias("t")
    )
    pct = F.try_divide(F.col("t.n") * 100.0, F.col("_rows").cast("double"))
    counted = shares.select("column", F.explode(F.array(
        F.struct(F.lit("n").alias("k"), F.col("t.n").cast("double").alias("value")),
        F.struct(F.lit("pct1").alias("k"), F.round(pct, 1).alias("value")),
        F.struct(F.lit("pct2").alias("k"), F.round(pct, 2).alias("value")),
    )).alias("e")).select(F.concat_ws(".", F.lit("categorical"), "column", "e.k").alias("path"), "e.value")
    shape = f.shape.select(F.explode(F.array(
        F.struct(F.lit("shape.n_rows").alias("path"), F.col("n_rows").cast("double").alias("value")),
        F.struct(F.lit("shape.n_columns").alias("path"), F.col("n_columns").cast("double").alias("value")),
    )).alias("e")).select("e.path", "e.value")
    quality = f.quality.select(F.lit("quality.score").alias("path"), F.col("score").cast("double").alias("value"))

    def pairs(df, kind):
        hidden1 = F.broadcast(out.select(F.col("column").alias("col1")))
        hidden2 = F.broadcast(out.select(F.col("column").alias("col2")))
        return df.join(hidden1, "col1", "left_anti").join(hidden2, "col2", "left_anti").where("r is not null").select(
            F.concat_ws(".", F.lit(kind), "col1", "col2").alias("path"), F.round("r", 4).alias("value")
        )

    trained = f.model.where("status = 'trained'")
    metrics = trained.select(F.explode("metrics").alias("k", "value")).select(F.concat_ws(".", F.lit("model"), "k").alias("path"), "value")
    sizes = trained.select(F.explode(F.array(
        F.struct(F.lit("model.train_rows").alias("path"), F.col("train_rows").cast("double").alias("value")),
        F.struct(F.lit("model.test_rows").alias("path"), F.col("test_rows").cast("double").alias("value")),
    )).alias("e")).select("e.path", "e.value")
    drivers = f.importance.join(F.broadcast(out), F.col("feature") == F.col("column"), "left_anti").select(
        F.concat_ws(".", F.lit("importance"), "feature").alias("path"), F.col("importance").alias("value")
    )
    everything = shape
    for part in (quality, stats, uniques, counted, pairs(f.pearson, "pearson"), pairs(f.spearman, "spearman"), metrics, sizes, drivers):
        everything = everything.unionByName(part)
    share_path = F.col("path").startswith("categorical.") & F.col("path").rlike(r"\.pct[12]$")
    return everything.where("value is not null").select(
        F.lit(f.dataset_id).alias("dataset_id"), "path", "value", (~share_path & (F.col("value") % 1 == 0)).alias("is_int")
    )


def evidence_summary(f: Facts) -> DataFrame:
    """One row with a JSON document: profile, column statistics, five top pairs, five drivers."""
    out = F.broadcast(excluded_columns(f.profile))
    num = f.numeric.join(out, "column", "left_anti").agg(
        F.array_sort(F.collect_list(F.struct("column", "mean", "median", "std", "min", "max"))).alias("numeric_summaries")
    )
    cat = f.categorical.join(out, "column", "left_anti").agg(
        F.array_sort(F.collect_list(F.struct("column", "unique_count", "top_categories"))).alias("categorical_summaries")
    )
    top = best_pairs(f).limit(5).agg(F.collect_list(F.struct("col1", "col2", "pearson_r")).alias("correlations"))
    drivers = f.importance.join(out, F.col("feature") == F.col("column"), "left_anti").orderBy(F.desc("importance"), "feature").limit(5).agg(
        F.collect_list(F.struct("feature", "importance")).alias("top_features")
    )
    model = f.model.agg(F.first(F.struct(*f.model.columns)).alias("machine_learning"))
    issues = f.issues.agg(F.collect_list("issue").alias("quality_issues"))
    one = f.shape.join(f.quality.select("score"), how="cross").join(f.domain.select("domain"), how="cross")
    for part in (issues, num, cat, top, model, drivers):
        one = one.join(part, how="cross")  # one row each
    doc = F.struct(
        F.struct("domain", F.col("n_rows").alias("rows"), F.col("n_columns").alias("columns"), F.col("score").alias("quality_score"), "quality_issues").alias("dataset_profile"),
        "numeric_summaries", "categorical_summaries", "correlations", "machine_learning", "top_features",
    )
    return one.select(F.lit(f.dataset_id).alias("dataset_id"), F.to_json(doc).alias("evidence"))


def best_pairs(f: Facts) -> DataFrame:
    out = excluded_columns(f.profile)
    return (
        f.pearson.where("r is not null")
        .join(F.broadcast(out.select(F.col("column").alias("col1"))), "col1", "left_anti")
        .join(F.broadcast(out.select(F.col("column").alias("col2"))), "col2", "left_anti")
        .select("i", "j", "col1", "col2", F.round("r", 4).alias("pearson_r"))
        .orderBy(F.desc(F.abs("pearson_r")), "i", "j")
    )


INSIGHT = ("priority", "place", "category", "text", "confidence", "evidence", "recommendation")


def _two(c: str):
    return F.format_string("%.2f", F.col(c).cast("double"))


def model_insights(f: Facts) -> DataFrame:
    """Model score and strongest driver."""
    out = F.broadcast(excluded_columns(f.profile))
    trained = f.model.where("status = 'trained'")
    m = F.col("metrics")
    score = trained.select(
        F.lit(1).alias("priority"), F.lit(1).alias("place"), F.lit("machine_learning").alias("category"),
        F.when(F.col("task") == "classification", F.format_string(
            V.SAYS["classifier_score"],
            F.col("selected_model"), F.coalesce(m["f1"], F.lit(0.0)), F.coalesce(m["accuracy"], F.lit(0.0)) * 100.0, F.col("target")))
        .otherwise(F.format_string(
            V.SAYS["regressor_score"],
            F.col("selected_model"), F.coalesce(m["rmse"], F.lit(0.0)), F.coalesce(m["r2"], F.lit(0.0)), F.col("target"))).alias("text"),
        F.lit(0.85).alias("confidence"), F.lit("model.metrics").alias("evidence"),
        F.format_string("Use the %s model for predictions on new records.", F.col("selected_model")).alias("recommendation"),
    )
    driver = (
        f.importance.join(out, F.col("feature") == F.col("column"), "left_anti")
        .orderBy(F.desc("importance"), "feature").limit(1).select(
            F.lit(1).alias("priority"), F.lit(2).alias("place"), F.lit("machine_learning").alias("category"),
            F.format_string(V.SAYS["driver"], F.col("feature"), F.col("importance") * 100.0).alias("text"),
            F.lit(0.80).alias("confidence"), F.concat(F.lit("model.importance."), "feature").alias("evidence"),
            F.format_string("Focus on managing variations in '%s'.", F.col("feature")).alias("recommendation"),
        )
    )
    return score.unionByName(driver)


def correlation_insights(f: Facts) -> DataFrame:
    """At most two pairs with |r| >= 0.20, banded strong / moderate / mild."""
    r, a = F.col("pearson_r"), F.abs("pearson_r")
    band = F.when(a >= 0.70, "strong").when(a >= 0.40, "moderate").otherwise("mild")
    w = Window.orderBy(F.desc("a"), "i", "j")
    top = best_pairs(f).where(a >= 0.20).withColumn("a", a).limit(2).withColumn("place", F.row_number().over(w))
    return top.select(
        F.lit(2).alias("priority"), "place", F.lit("correlation").alias("category"),
        F.format_string(V.SAYS["correlation"], band, F.when(r > 0, "positive").otherwise("negative"), r, F.col("col1"), F.col("col2")).alias("text"),
        F.lit(0.90).alias("confidence"), F.concat_ws(".", F.lit("correlations.pearson"), "col1", "col2").alias("evidence"),
        F.format_string("Evaluate whether '%s' and '%s' depend on each other.", F.col("col1"), F.col("col2")).alias("recommendation"),
    )


def spread_insights(f: Facts) -> DataFrame:
    """The two numeric columns with the largest standard deviation."""
    out = F.broadcast(excluded_columns(f.profile))
    place = f.profile.select(F.col("name").alias("column"), "ordinal")
    top = f.numeric.where("count > 0").join(out, "column", "left_anti").join(F.broadcast(place), "column", "left").orderBy(F.desc("std"), "ordinal").limit(2)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("std"), "ordinal"))).select(
        F.lit(3).alias("priority"), "place", F.lit("distribution").alias("category"),
        F.concat(F.lit("Column '"), "column", F.lit("' averages "), _two("mean"), F.lit(" (median: "), _two("median"), F.lit(") spanning a range from "), _two("min"), F.lit(" to "), _two("max"), F.lit(".")).alias("text"),
        F.lit(0.95).alias("confidence"), F.concat(F.lit("summary.numeric."), "column").alias("evidence"),
        F.format_string("Set thresholds for unusual values of '%s'.", F.col("column")).alias("recommendation"),
    )


def leader_insights(f: Facts) -> DataFrame:
    """The first two categorical columns with their leading value and its share of rows."""
    out = F.broadcast(excluded_columns(f.profile))
    place = f.profile.select(F.col("name").alias("column"), "ordinal")
    first = (
        f.categorical.join(out, "column", "left_anti").join(F.broadcast(place), "column", "left").orderBy("ordinal").limit(2)
        .where("top_category is not null").join(f.shape, how="cross").where("n_rows > 0")
    )
    return first.withColumn("place", F.row_number().over(Window.orderBy("ordinal"))).select(
        F.lit(4).alias("priority"), "place", F.lit("distribution").alias("category"),
        F.format_string(V.SAYS["leader"], F.col("column"), F.col("unique_count"), F.col("top_category"), F.col("top_category_freq"), F.col("top_category_freq") * 100.0 / F.col("n_rows")).alias("text"),
        F.lit(0.95).alias("confidence"), F.concat(F.lit("summary.categorical."), "column").alias("evidence"),
        F.format_string("Segment reports by '%s'.", F.col("column")).alias("recommendation"),
    )


def size_insight(f: Facts) -> DataFrame:
    return f.shape.join(f.quality.select("score"), how="cross").where("n_rows > 0 and n_columns > 0").select(
        F.lit(5).alias("priority"), F.lit(1).alias("place"), F.lit("quality").alias("category"),
        F.format_string(V.SAYS["size"], F.col("n_rows"), F.col("n_columns"), F.col("score")).alias("text"),
        F.lit(1.0).alias("confidence"), F.lit("quality.score").alias("evidence"),
        F.lit("Keep data ingestion standardised to preserve data quality.").alias("recommendation"),
    )


def rule_insights(f: Facts, max_insights: int = 10) -> DataFrame:
    """All rule insights: unique texts in priority order, capped, numbered ins_001..."""
    rows = model_insights(f)
    for part in (correlation_insights(f), spread_insights(f), leader_insights(f), size_insight(f)):
        rows = rows.unionByName(part)
    return number_insights(rows, max_insights)


def number_insights(rows: DataFrame, max_insights: int) -> DataFrame:
    """De-duplicate by text, keep the first ``max_insights`` and number them.

    A feature limit (a report shows few insights), applied to a table of rule results.
    """
    first = rows.groupBy("text").agg(F.min_by(F.struct(*[c for c in INSIGHT if c != "text"]), F.struct("priority", "place")).alias("r"))
    flat = first.select("text", "r.*").orderBy("priority", "place", "text").limit(max_insights)
    w = Window.orderBy("priority", "place", "text")
    return flat.select(
        F.format_string("ins_%03d", F.row_number().over(w)).alias("id"), "category", "text", "confidence", "evidence", "recommendation",
        numbers_in(F.col("text")).alias("grounded_numbers"),
    )


def merge_insights(accepted: DataFrame, rules: DataFrame, min_insights: int = 3, max_insights: int = 10) -> DataFrame:
    """Accepted claims first; rule insights fill up only below the minimum; never padded."""
    a = accepted.select(F.lit(0).alias("priority"), F.col("place").cast("int").alias("place"), F.lower(F.trim("category")).alias("category"), "text", F.col("confidence").cast("double").alias("confidence"), "evidence", "recommendation")
    n = a.agg(F.count("*").alias("_have"))
    fill = rules.join(n, how="cross").where(F.col("_have") < min_insights).select(
        F.lit(9).alias("priority"), F.substring("id", 5, 3).cast("int").alias("place"), "category", "text", "confidence", "evidence", "recommendation"
    )
    return number_insights(a.unionByName(fill), max_insights)


def chat_context(f: Facts, insights: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """One row (context): overview, domain, quality, eight statistic lines, model, six insights."""
    hidden = F.broadcast(shielded_columns(f.profile))
    place = f.profile.select(F.col("name").alias("column"), "ordinal")
    nums = f.numeric.join(hidden, "column", "left_anti").join(place, "column").select(
        "ordinal", F.format_string("- **%s** (numeric): mean=%s, min=%s, max=%s", F.col("column"), F.col("mean").cast("string"), F.col("min").cast("string"), F.col("max").cast("string")).alias("line")
    )
    cats = f.categorical.where("top_category is not null").join(hidden, "column", "left_anti").join(place, "column").select(
        "ordinal", F.format_string("- **%s** (categorical): unique=%d, top='%s'", F.col("column"), F.col("unique_count"), F.col("top_category")).alias("line")
    )
    lines = nums.unionByName(cats).orderBy("ordinal").limit(8).agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("l")).select(
        F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("stat_lines")
    )
    issues = f.issues.limit(5).agg(F.array_join(F.collect_list("issue"), "; ").alias("issues"))
    told = insights.orderBy("id").limit(6).agg(F.array_sort(F.collect_list(F.struct("id", "text", "recommendation"))).alias("l")).select(
        F.array_join(F.transform("l", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["text"], F.lit(" (Recommendation: "), e["recommendation"], F.lit(")"))), "\n").alias("told")
    )
    model = f.model.agg(F.first("status").alias("status"), F.first("task").alias("task"), F.first("target").alias("target"), F.first("selected_model").alias("best"), F.first("metrics").alias("metrics"))
    one = f.shape.join(f.domain, how="cross").join(f.quality.select("score"), how="cross")
    for part in (issues, lines, model, told):
        one = one.join(part, how="cross")  # one row each
    metrics = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,double>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    text = F.concat_ws(
        "\n\n",
        F.format_string("### Dataset Overview\n- Total Rows: %d\n- Total Columns: %d", F.col("n_rows"), F.col("n_columns")),
        F.format_string("### Domain\n- Detected Domain: %s (Confidence: %.1f%%)", F.initcap("domain"), F.col("confidence") * 100.0),
        F.format_string("### Data Quality\n- Quality Score: %d/100\n- Key Issues: %s", F.col("score"), F.when(F.col("issues") == "", V.SAYS["no_anomalies"]).otherwise(F.col("issues"))),
        F.when(F.col("stat_lines") != "", F.concat(F.lit("### Key Statistical Summaries\n"), "stat_lines")),
        F.when(F.col("status").isNotNull(), F.concat(
            F.lit("### Machine Learning\n- Status: "), "status", F.lit("\n- Task Type: "), F.coalesce("task", F.lit("None")), F.lit("\n- Target Column: "), F.coalesce("target", F.lit("None")),
            F.lit("\n- Selected Model: "), F.coalesce("best", F.lit("None")), F.lit("\n- Held-out Metrics: "), F.when(metrics == "", "N/A").otherwise(metrics))),
        F.when(F.col("told") != "", F.concat(F.lit("### Executive Insights\n"), "told")),
    )
    cap = max_tokens * 4
    return one.select(text.alias("full")).select(
        F.when(F.length("full") > cap, F.concat(F.substring("full", 1, cap), F.lit(V.SAYS["truncated"]))).otherwise(F.col("full")).alias("context")
    )


def fact_answers(f: Facts, insights: DataFrame) -> DataFrame:
    """(topic, answer): the six keyword answers."""
    issues = f.issues.agg(F.array_join(F.collect_list("issue"), "; ").alias("issues"))
    quality = f.quality.join(issues, how="cross").select(
        F.lit("quality").alias("topic"),
        F.format_string(V.SAYS["quality_answer"], F.col("score"), F.when(F.col("issues") == "", V.SAYS["no_defects"]).otherwise(F.col("issues"))).alias("answer"),
    )
    domain = f.domain.select(F.lit("domain").alias("topic"), F.format_string(V.SAYS["domain_answer"], F.initcap("domain"), F.col("confidence") * 100.0).alias("answer"))
    shape = f.shape.select(F.lit("shape").alias("topic"), F.format_string(V.SAYS["shape_answer"], F.col("n_rows"), F.col("n_columns")).alias("answer"))
    metrics = F.array_join(F.transform(F.array_sort(F.map_entries("metrics")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    model = f.model.select(
        F.lit("model").alias("topic"),
        F.when(F.col("status") == "insufficient_data", V.SAYS["too_few_rows"])
        .when(F.col("status") == "unsupported", V.SAYS["no_target"])
        .when(F.col("status") == "trained", F.concat(F.lit("Model training completed ("), "task", F.lit("). Best performing model: "), "selected_model", F.lit(" on target '"), "target", F.lit("'. Metrics: "), metrics, F.lit(".")))
        .otherwise(F.concat(F.lit("Machine learning status: "), "status", F.lit("."))).alias("answer"),
    )
    told = insights.orderBy("id").limit(3).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("l")).select(
        F.lit("insights").alias("topic"),
        F.when(F.size("l") == 0, V.SAYS["no_insights"])
        .otherwise(F.concat(F.lit("Key analytical insights:\n"), F.array_join(F.transform("l", lambda e: F.concat(F.lit("- "), e["text"])), "\n"))).alias("answer"),
    )
    targets = f.profile.where("is_target_candidate").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("l")).select(
        F.lit("targets").alias("topic"),
        F.when(F.size("l") == 0, V.SAYS["no_candidates"])
        .otherwise(F.concat(F.lit("Potential target candidates identified in the dataset: "), F.array_join(F.transform("l", lambda e: e["name"]), ", "), F.lit("."))).alias("answer"),
    )
    out = quality
    for part in (domain, shape, model, told, targets):
        out = out.unionByName(part)
    return out


def limitations(f: Facts, insights: DataFrame) -> DataFrame:
    """(place, limitation): quality issues, vague dates, model status, missing insights."""
    a = f.issues.select(F.lit(1).alias("place"), F.concat(F.lit("Data Quality Issue: "), "issue").alias("limitation"))
    b = f.dates.where("needs_confirmation").select(F.lit(2).alias("place"), F.format_string(V.SAYS["date_limit"], F.col("column")).alias("limitation"))
    c = f.model.where(F.col("status").isin("insufficient_data", "unsupported", "leakage_detected")).select(F.lit(3).alias("place"), F.concat(F.lit("Machine Learning Limitation: "), F.coalesce(F.nullif("reason", F.lit("")), F.concat(F.lit("Status "), "status"))).alias("limitation"))
    d = insights.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(4).alias("place"), F.lit(V.SAYS["insight_limit"]).alias("limitation"))
    return a.unionByName(b).unionByName(c).unionByName(d).orderBy("place", "limitation")


def report_payload(f: Facts, insights: DataFrame) -> DataFrame:
    """One nested row with everything a renderer needs; sensitive columns show no values."""
    out = F.broadcast(excluded_columns(f.profile))
    is_id = F.col("semantic_label") == "identifier"
    badge = F.when(F.col("is_pii"), F.concat(F.lit("PII: "), F.upper("pii_type"))).when(is_id, "IDENTIFIER").otherwise("SAFE")
    catalogue = f.profile.agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "dtype_inferred", "semantic_label", "null_pct", "unique_count", "is_pii", is_id.alias("is_identifier"), badge.alias("badge")))).alias("columns"))
    pii = f.profile.where("is_pii").agg(F.array_sort(F.collect_list("name")).alias("pii_columns"))
    fills = F.col("method").isin("mean", "median", "mode", "constant", "constant_unknown")
    hidden = f.profile.where(F.col("is_pii") | is_id).select(F.col("name").alias("column"), F.lit(True).alias("hide"))
    log = f.cleaning.join(F.broadcast(hidden), "column", "left")
    value = F.when(F.col("hide"), "[MASKED_PII]").otherwise(F.col("replacement_value"))
    cleaning = log.agg(
        F.coalesce(F.sum(F.when(F.col("method") == "drop_duplicates", F.col("details")["duplicate_count"])), F.lit(0.0)).cast("long").alias("duplicates_removed"),
        F.count_if(fills).alias("imputation_count"),
        F.array_sort(F.collect_list(F.struct("step_no", "column", "method", value.alias("replacement_value")))).alias("operations"),
    ).select(F.struct("duplicates_removed", "imputation_count", "operations").alias("cleaning"))
    stats = f.numeric.join(out, "column", "left_anti").agg(F.array_sort(F.collect_list(F.struct("column", *[_two(c).alias(c) for c in ("mean", "std", "min", "median", "max")]))).alias("summary_stats"))
    pairs = best_pairs(f).limit(10).agg(F.collect_list(F.struct("col1", "col2", "pearson_r")).alias("top_correlations"))
    model = f.model.agg(F.first(F.struct(*f.model.columns)).alias("model"))
    drivers = f.importance.agg(F.collect_list(F.struct("feature", "importance")).alias("feature_importances"))
    told = insights.agg(F.array_sort(F.collect_list(F.struct("id", "category", "text", "confidence", "evidence", "recommendation"))).alias("insights"), F.array_sort(F.collect_set("recommendation")).alias("recommendations"))
    limits = limitations(f, insights).agg(F.collect_list("limitation").alias("limitations"))
    issues = f.issues.agg(F.collect_list("issue").alias("issues"))
    one = f.shape.select(F.lit(f.dataset_id).alias("dataset_id"), "n_rows", "n_columns").join(f.domain.select(F.struct("domain", "confidence").alias("domain")), how="cross").join(f.quality.select("score"), how="cross")
    for part in (issues, catalogue, pii, cleaning, stats, pairs, model, drivers, told, limits):
        one = one.join(part, how="cross")  # one row each
    return one
