"""Target choice, leakage guards, splits, Spark ML candidates, metrics and selection."""

from __future__ import annotations

import math
import re
from urllib.parse import urlsplit

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C, feature as P, regression as R
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from tabwise.functions import fixed as V
from tabwise.functions.exprs import as_double, as_text, is_numeric, is_post_outcome, q, safe_corr, sample_skewness
from tabwise.operators.cells import Cells, feature_points, features_of, find_cells, fit_cells
from tabwise.operators.quantiles import running_start
from tabwise.session import checkpoint_cut, local_table, settle, stage
from tabwise.sources.rowid import with_row_ids
from tabwise.sources.scan import list_files, scan_files

BOOST_MIN_ROWS = 500
FEW_CLASSES = 10_000  # tables of so many classes are broadcast; larger ones are joined by shuffle
MAX_CATEGORIES = 20
CELL_MODELS = {"random_forest", "boosted_trees"}
TREES = 100
TREE_DEPTH = 30  # the deepest Spark grows
LEAF_ROWS = 2  # stands in for "no split of fewer than 4 rows", which Spark cannot state
CELL_ROWS = 200_000  # tables of more rows are staged as Parquet, and their trees grown from cells of rows alike in all bins
PART_ROWS = 2_000_000  # rows of a part of the split table; every part sends the statistics of all open nodes of a forest


# --- target ---------------------------------------------------------------------

def pick_target(profile: DataFrame, preferred: str | None = None) -> DataFrame:
    """(target, why): at most one row, by a fixed ranking over the column catalogue.

    Preferred column, single candidate, labelled target, name keyword, few distinct
    values, first candidate.
    """
    profile = settle(profile)  # read three times below
    label = F.col("semantic_label")
    usable = profile.where(~F.col("is_pii") & (label != "identifier"))
    labelled = label.isin("target_label", "target_value")
    cands = usable.where(F.col("is_target_candidate") | labelled)
    wanted = F.col("name") == F.lit(preferred) if preferred else F.lit(False)
    pool = usable.where(wanted).unionByName(cands).dropDuplicates(["name"])
    word = F.lit(False)
    for w in V.TARGET_WORDS:
        word = word | F.lower("name").contains(w)
    count = cands.agg(F.count("*")).scalar()
    rank = (
        F.when(wanted, 1).when(count == 1, 2).when(labelled, 3)
        .when(word, 4).when(F.col("unique_count") <= 10, 5).otherwise(6)
    )
    why = (
        F.when(F.col("rank") == 1, "preferred").when(F.col("rank") == 2, "single candidate")
        .when(F.col("rank") == 3, "target label").when(F.col("rank") == 4, "outcome keyword")
        .when(F.col("rank") == 5, "few values").otherwise("first candidate")
    )
    return (
        pool.withColumn("rank", rank)
        .orderBy("rank", "ordinal").limit(1)
        .select(F.col("name").alias("target"), why.alias("why"), "dtype_inferred", "unique_count", "n_rows", "null_count")
    )


def task_type(dtype_inferred: str, n_unique: int, filled: int) -> tuple[str, str, str]:
    """(task, subtype, status) of a chosen target."""
    if filled == 0:
        return "none", "none", "invalid_target"
    if n_unique <= 1:
        return "none", "none", "constant_target"
    if dtype_inferred in ("category", "bool", "string") or (dtype_inferred == "int" and n_unique <= 10):
        return "classification", "binary" if n_unique == 2 else "multiclass", "ready"
    return "regression", "continuous", "ready"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, n, pct, imbalance_ratio) of the filled target rows."""
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = (
        df.select(as_text(target, types[target]).alias("class")).where("class is not null")
        .groupBy("class").agg(F.count("*").alias("n"))
    )
    whole = counts.agg(F.struct(F.sum("n").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi"))).scalar()
    return counts.select(
        "class", "n", F.round(F.col("n") / whole["t"] * 100.0, 2).alias("pct"),
        F.round(whole["hi"] / F.greatest(F.lit(1), whole["lo"]), 2).alias("imbalance_ratio"),
    )


def check_sufficiency(
    df: DataFrame, target: str, task: str, min_rows: int = V.MIN_MODEL_ROWS, min_class: int = V.MIN_CLASS_ROWS
) -> DataFrame:
    """One row (ok, code, rows, n_classes, min_class, mean, std, skewness) for a target."""
    types = {f.name: f.dataType for f in df.schema.fields}
    t = as_text(target, types[target])
    rows = df.agg(F.count(t).alias("rows"))
    if task == "classification":
        facts = df.select(t.alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n")).agg(
            F.count("*").alias("n_classes"), F.min("n").alias("min_class")
        ).withColumns({"mean": F.lit(None).cast("double"), "std": F.lit(None).cast("double"), "skewness": F.lit(None).cast("double")})
        bad = (
            F.when(F.col("rows") < min_rows, "insufficient_data").when(F.col("n_classes") < 2, "invalid_target")
            .when(F.col("min_class") < min_class, "insufficient_data")
        )
    else:
        x = as_double(target, types[target])
        facts = df.agg(
            F.lit(None).cast("long").alias("n_classes"), F.lit(None).cast("long").alias("min_class"),
            F.round(F.avg(x), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("std"),
            F.round(sample_skewness(x, F.count(x)), 4).alias("skewness"),
        )
        bad = F.when(F.col("rows") < min_rows, "insufficient_data").when(F.col("std") == 0, "invalid_target")
    return rows.join(facts, how="cross").select(
        bad.isNull().alias("ok"), F.coalesce(bad, F.lit("ready")).alias("code"), "rows", "n_classes", "min_class", "mean", "std", "skewness"
    )


# --- leakage --------------------------------------------------------------------

def structural_exclusions(profile: DataFrame, target: str) -> DataFrame:
    """(ordinal, column, reason) with reason NULL where the column may be a feature."""
    return profile.select(
        "ordinal",
        F.col("name").alias("column"),
        F.when(F.col("name") == target, "target_column")
        .when(F.col("is_pii"), "pii_protection")
        .when(F.col("semantic_label") == "identifier", "identifier_exclusion")
        .when(is_post_outcome(F.col("name")), "post_outcome_name_match").alias("reason"),
    )


def leakage_pearson(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(column, measured): |r| of each numeric feature with a numeric target, one pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    y = as_double(target, types[target])
    if not features:
        return local_table(df.sparkSession, [], "column string, measured double")
    wide = df.agg(*[F.abs(safe_corr(as_double(c, types[c]), y)).alias(f"r{i}") for i, c in enumerate(features)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(f"r{i}", F.lit(0.0)).alias("measured")) for i, c in enumerate(features)
    ])))


def leakage_nmi(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(column, measured): normalised mutual information with the target.

    Contingency counts of all features come from one shuffle of (column, value, target)
    with partial sums; the two marginals are aggregations of those counts.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if not features:
        return local_table(df.sparkSession, [], "column string, measured double")
    text = df.select(as_text(target, types[target]).alias("__y"), *[as_text(c, types[c]).alias(c) for c in features])
    cells = (
        text.where("__y is not null").unpivot(["__y"], [q(c) for c in features], "column", "value")
        .where("value is not null").groupBy("column", "value", "__y").agg(F.count("*").alias("n"))
    )
    def entropy(counts: DataFrame, name: str) -> DataFrame:
        # sum over cells of n*ln(n); turned into an entropy with the total below
        return counts.groupBy("column").agg(
            F.sum(F.col("n") * F.log("n")).alias(name), F.sum("n").alias("total_" + name), F.count("*").alias("cells_" + name)
        )
    joint = entropy(cells, "xy")
    x = entropy(cells.groupBy("column", "value").agg(F.sum("n").alias("n")), "x")
    y = entropy(cells.groupBy("column", "__y").agg(F.sum("n").alias("n")), "y")
    n = F.col("total_xy")
    hx = F.log(n) - F.col("x") / n
    hy = F.log(n) - F.col("y") / n
    hxy = F.log(n) - F.col("xy") / n
    mi = F.greatest(F.lit(0.0), hx + hy - hxy)
    single = (F.col("cells_x") == 1) & (F.col("cells_y") == 1)
    nmi = (
        F.when(n <= 2, 0.0).when(single, 1.0)
        .when(mi <= 1e-12, 0.0).otherwise(mi / ((hx + hy) / 2))
    )
    names = local_table(df.sparkSession, [(c,) for c in features], "column string")
    return names.join(joint.join(x, "column").join(y, "column"), "column", "left").select(
        "column", F.coalesce(nmi, F.lit(0.0)).alias("measured")
    )


def leakage_audit(df: DataFrame, profile: DataFrame, target: str, limit: float = V.LEAKAGE_LIMIT) -> DataFrame:
    """One audit row per column: method, threshold, measured value, retained / excluded."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rules = structural_exclusions(profile, target)
    open_cols = [r["column"] for r in rules.where("reason is null").collect() if r["column"] in types]
    numeric_target = is_numeric(types[target])
    pearson = [c for c in open_cols if numeric_target and is_numeric(types[c])]
    other = [c for c in open_cols if c not in pearson]
    measured = leakage_pearson(df, target, pearson).withColumn("method", F.lit("pearson_correlation")).unionByName(
        leakage_nmi(df, target, other).withColumn("method", F.lit("normalized_mutual_info"))
    )
    names = {
        "target_column": "target_identity", "pii_protection": "pii_metadata",
        "identifier_exclusion": "identifier_metadata", "post_outcome_name_match": "name_pattern_heuristic",
    }
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    leaky = F.coalesce(F.col("measured") >= limit, F.lit(False))
    return rules.join(measured, "column", "left").select(
        "ordinal",
        "column",
        F.coalesce(label[F.col("reason")], "method").alias("detection_method"),
        F.when(F.col("reason").isNull(), F.lit(limit)).alias("threshold_used"),
        F.when(F.col("reason") == "target_column", 1.0).otherwise(F.round("measured", 4)).alias("measured_value"),
        F.when(F.col("reason").isNotNull() | leaky, "excluded").otherwise("retained").alias("exclusion_status"),
        F.coalesce("reason", F.when(leaky, F.concat(F.lit("high_"), F.col("method"), F.lit("_leakage")))).alias("reason"),
    )


# --- split ----------------------------------------------------------------------

def split_rows(df: DataFrame, row_id: str, label: str | None = None, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: a repeatable split by hashed row id, stratified by ``label``.

    Every class is cut at its own exact quantile of the hash; with many rows the classes
    are never sorted: a per-class histogram of hash prefixes finds the cut-off prefix, and
    only rows sharing that one prefix are ranked.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    y = as_text(label, types[label]) if label else F.lit("all")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), q(row_id).cast("string")))
    keyed = df.withColumn("_y", y).withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 4))
    prefixes = keyed.groupBy("_y", "_p").agg(F.count("*").alias("_n"))  # 65536 per class at most
    w = Window.partitionBy("_y").orderBy("_p")
    cut = (
        prefixes.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
        .withColumn("_want", F.ceil(F.sum("_n").over(Window.partitionBy("_y")) * F.lit(test_share)))
        .where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want")))
        .select(F.col("_y").alias("_cy"), F.col("_p").alias("_cp"), (F.col("_want") - F.col("_before")).alias("_left"))
    )
    if label:  # one row per class
        cut = checkpoint_cut(cut)
        sent = F.broadcast if cut.count() <= FEW_CLASSES else lambda facts: facts
    else:
        sent = F.broadcast
    at = keyed.join(sent(cut), F.col("_y").eqNullSafe(F.col("_cy")))
    edge = at.where(F.col("_p") == F.col("_cp")).withColumn(
        "_k", F.row_number().over(Window.partitionBy("_y").orderBy("_h"))
    )
    last = edge.where(F.col("_k") <= F.col("_left")).groupBy("_y").agg(F.max("_h").alias("_cut"))
    return (
        keyed.join(sent(last.select(F.col("_y").alias("_cy"), "_cut")), F.col("_y").eqNullSafe(F.col("_cy")), "left")
        .withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)))
        .drop("_y", "_h", "_p", "_cy", "_cut")
    )


# --- features -------------------------------------------------------------------

def feature_stages(train: DataFrame, features: list[str]) -> tuple[list, dict[str, list[str]]]:
    """Preprocessing stages fitted on training rows only, and the kept categories.

    Numbers: median fill and standardisation.  Categories: 'Unknown' fill and one-hot
    with the 19 most frequent values plus one bucket for the rest.
    """
    types = {f.name: f.dataType for f in train.schema.fields}
    numeric = [c for c in features if is_numeric(types[c])]
    nominal = [c for c in features if c not in numeric]
    stages: list = []
    parts = []
    if numeric:
        stages += [
            P.Imputer(inputCols=[f"num_{c}" for c in numeric], outputCols=[f"fill_{c}" for c in numeric], strategy="median", relativeError=1e-4),
            P.VectorAssembler(inputCols=[f"fill_{c}" for c in numeric], outputCol="numbers"),
            P.StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ]
        parts.append("scaled")
    kept: dict[str, list[str]] = {}
    if nominal:
        counts = (
            train.select(*[F.coalesce(as_text(c, types[c]), F.lit("Unknown")).alias(c) for c in nominal])
            .unpivot([], [q(c) for c in nominal], "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
        )
        w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        for r in counts.withColumn("k", F.row_number().over(w)).where(F.col("k") < MAX_CATEGORIES).orderBy("column", "k").collect():
            kept.setdefault(r["column"], []).append(r["value"])
        for c in nominal:
            stages.append(P.StringIndexer(inputCol=f"cat_{c}", outputCol=f"idx_{c}", handleInvalid="keep"))
        stages.append(P.OneHotEncoder(inputCols=[f"idx_{c}" for c in nominal], outputCols=[f"hot_{c}" for c in nominal], handleInvalid="keep", dropLast=False))
        parts += [f"hot_{c}" for c in nominal]
    stages.append(P.VectorAssembler(inputCols=parts, outputCol="features"))
    return stages, kept


def fit_stages(stages: list, train: DataFrame) -> tuple[PipelineModel, list[list[float]]]:
    """(fitted stages, points of the numbers as ``cut_points`` takes them): medians and points come from one pass."""
    if not isinstance(stages[0], P.Imputer):
        return Pipeline(stages=stages).fit(train), []
    names = stages[0].getInputCols()
    medians, points = feature_points(train, names)
    fill = stages[0].fit(local_table(train.sparkSession, [medians], T.StructType([T.StructField(c, T.DoubleType()) for c in names])))
    return PipelineModel(stages=[fill, *Pipeline(stages=stages[1:]).fit(fill.transform(train)).stages]), points


def feature_inputs(df: DataFrame, features: list[str], kept: dict[str, list[str]]) -> DataFrame:
    """Typed model inputs; categories outside the kept list share one bucket."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in features:
        if is_numeric(types[c]):
            out[f"num_{c}"] = as_double(c, types[c])
        else:
            v = F.coalesce(as_text(c, types[c]), F.lit("Unknown"))
            out[f"cat_{c}"] = F.when(v.isin(kept.get(c, [])), v).otherwise("__infrequent__")
    return df.withColumns(out)


# --- metrics --------------------------------------------------------------------

def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, n): the only data-sized step of the classification metrics."""
    return scored.groupBy(q(label).cast("string").alias("actual"), q(prediction).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def classification_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, precision, recall, f1), four decimals.

    Two classes: of the positive class, the higher label.  More: unweighted class means.
    Empty denominators count as 0.
    """
    cells = confusion(scored, label, prediction)
    rows = cells.select(F.col("actual").alias("class"), F.col("n").alias("actual_n"), F.lit(0).cast("long").alias("pred_n"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"))
    cols = cells.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("actual_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("tp"))
    per = rows.unionByName(cols).where("class is not null").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("actual_n").alias("a"), F.sum("pred_n").alias("p"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("a").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("a") + F.col("p")).cast("double")), F.lit(0.0))
    per = per.select("class", "tp", "a", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    two = F.count("*") <= 2

    def pick(c):
        return F.round(F.when(two, F.max_by(c, F.struct(F.col("class").try_cast("double"), F.col("class")))).otherwise(F.avg(c)), 4)

    return per.agg(
        F.round(F.sum("tp") / F.sum("a"), 4).alias("accuracy"), pick("prec").alias("precision"),
        pick("rec").alias("recall"), pick("f1").alias("f1"),
    )


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(roc_auc): exact, ties shared, from counts per distinct score.

    With both classes counted per score, AUC is a running sum over scores, taken in
    ordered ranges; rows are never ranked one by one.
    """
    y = q(label).cast("int")
    per = scored.select(q(score).cast("double").alias("value"), y.alias("y")).where("value is not null and y is not null").groupBy("value").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg")
    )
    below = running_start(per, "value", "neg")
    return below.agg(
        F.round(F.try_divide(
            F.sum(F.col("pos") * (F.col("start") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")
        ), 4).alias("roc_auc")
    )


def regression_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """(mae, mse, rmse, r2), four decimals, one pass."""
    y, p = q(label).cast("double"), q(prediction).cast("double")
    err = y - p
    sst = F.var_pop(y) * F.count(y)
    sse = F.sum(err * err)
    return scored.where(y.isNotNull() & p.isNotNull()).agg(
        F.round(F.avg(F.abs(err)), 4).alias("mae"), F.round(F.avg(err * err), 4).alias("mse"),
        F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"),
        F.round(F.coalesce(1 - F.try_divide(sse, sst), F.lit(0.0)), 4).alias("r2"),
    )


# --- training -------------------------------------------------------------------

def baseline_prediction(train: DataFrame, label: str, task: str) -> Column:
    """Majority class (smallest on ties) or mean of the training rows, as a literal."""
    if task == "classification":
        best = train.groupBy(label).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), q(label)))).first()[0]
        return F.lit(float(best[label]))
    return F.lit(float(train.agg(F.avg(label)).first()[0]))


def candidates(task: str, n_train: int, n_classes: int, trees: int = TREES, rounds: int = 100, depth: int = TREE_DEPTH) -> dict[str, object]:
    """Model name -> estimator, or None where a candidate does not apply.

    Forests keep each row's node of every tree: else each level walks all deep trees from their roots and sends them whole.
    """
    if task == "classification":
        boost = C.GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.9, seed=42, weightCol="weight")
        return {
            "logistic_regression": C.LogisticRegression(labelCol="label", featuresCol="features", weightCol="weight", regParam=1.0 / n_train, maxIter=1000, standardization=False),
            "random_forest": C.RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF_ROWS, cacheNodeIds=True, seed=42),
            "boosted_trees": None if n_train < BOOST_MIN_ROWS else boost if n_classes <= 2 else C.OneVsRest(classifier=boost, labelCol="label", featuresCol="features", weightCol="weight", parallelism=min(n_classes, 8)),
        }
    boost = R.GBTRegressor(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.9, seed=42)
    return {
        "ridge": R.LinearRegression(labelCol="label", featuresCol="features", elasticNetParam=0.0, regParam=1.0 / n_train, standardization=False),
        "random_forest": R.RandomForestRegressor(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF_ROWS, cacheNodeIds=True, seed=42),
        "boosted_trees": boost if n_train >= BOOST_MIN_ROWS else None,
    }


def class_table(df: DataFrame, target: str) -> DataFrame:
    """(class, label): every class with its place in the order of names, so the higher one of two is positive."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = df.select(as_text(target, types[target]).alias("class")).where("class is not null").distinct()
    return with_row_ids(names.orderBy("class"), row_id="_place").select("class", F.col("_place").cast("double").alias("label"))


def one_against_rest(scored: DataFrame) -> DataFrame:
    """Add ``probability``: each class's chance by its own boosted model against the rest, scaled to sum to one."""
    from pyspark.ml.functions import vector_to_array

    own = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
    total = F.aggregate("_own", F.lit(0.0), lambda s, x: s + x)
    return scored.withColumn("_own", own).withColumn("probability", F.transform("_own", lambda x: F.try_divide(x, total))).drop("_own")


def fit_parts(spark: SparkSession, n_rows: int) -> int:
    """Parts of a table that fits read many times: one for each core at least, though its file be one task's input."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_rows / PART_ROWS))


def with_score(scored: DataFrame) -> DataFrame:
    """Add ``_s``: the chance of the higher of two classes."""
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("_s", vector_to_array("probability")[1])


def cell_scores(model: PipelineModel, cells: Cells, rows: DataFrame, n_classes: int) -> DataFrame:
    """(label, prediction, _s for two classes) of all rows: trees say the same of every row of a cell."""
    at = model.transform(cells.inputs)
    if n_classes == 2 and "probability" in at.columns:
        at = with_score(at)
    at = settle(at.select("_code", "prediction", *[c for c in ("_s",) if c in at.columns]))
    return rows.select(cells.code.alias("_code"), "label").join(F.broadcast(at), "_code").drop("_code")


def train_models(
    df: DataFrame, target: str, features: list[str], task: str, row_id: str, trees: int = TREES, rounds: int = 100,
    only: list[str] | None = None,
) -> tuple[DataFrame, dict[str, PipelineModel], DataFrame]:
    """(leaderboard, fitted models, split table) of baseline and candidates.

    The split table is staged once in parts for all cores: every fit reads it many times.  Above ``CELL_ROWS`` the trees
    are grown from cells, unless there are too many of these (``find_cells``), and score a point of every cell.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.where(q(target).isNotNull())
    n_rows = rows.count()
    parts, large = fit_parts(spark, n_rows), n_rows > CELL_ROWS
    split = split_rows(rows, row_id, target if task == "classification" else None)
    if task == "classification":
        classes = checkpoint_cut(class_table(rows, target))
        n_classes = classes.count()
        sent = F.broadcast if n_classes <= FEW_CLASSES else lambda facts: facts
        split = split.join(sent(classes.toDF("_class", "label")), as_text(target, types[target]) == F.col("_class")).drop("_class")
    else:
        split = split.withColumn("label", as_double(target, types[target]))
        n_classes = 0
    if large:  # first of all: what follows reads it several times
        split = stage(split if rows.rdd.getNumPartitions() >= parts else split.repartition(parts), "split")
    train = split.where(~F.col("is_test"))
    stages, kept = feature_stages(train, features)
    split = feature_inputs(split, features, kept)
    if task == "classification":
        per = checkpoint_cut(train.groupBy("label").agg(F.count("*").alias("n")))
        n, k = per.agg(F.sum("n"), F.count("*")).first()
        weights = per.select(F.col("label").alias("_label"), (F.lit(float(n)) / (F.lit(k) * F.col("n"))).alias("_weight"))
        split = split.join(sent(weights), F.col("label") == F.col("_label"), "left").withColumn("weight", F.coalesce("_weight", F.lit(1.0))).drop("_label", "_weight")
    else:
        split = split.withColumn("weight", F.lit(1.0))
    if not large:
        split = checkpoint_cut(split.repartition(parts))
    elif n_classes > FEW_CLASSES:  # joined by shuffle
        split = stage(split, "weighted")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    n_train = train.count()

    def score(scored: DataFrame) -> dict:
        if task == "classification":
            scored = scored.select("label", "prediction", *[c for c in ("probability", "_s") if c in scored.columns])
            if large and n_classes == 2 and "probability" in scored.columns:
                scored = with_score(scored).drop("probability")
            scored = stage(scored, "scored") if large else checkpoint_cut(scored)  # read several times
            m = classification_metrics(scored, "label", "prediction").first().asDict()
            if n_classes == 2 and "probability" in scored.columns:
                scored = with_score(scored)
            if "_s" in scored.columns:
                m["roc_auc"] = roc_auc(scored, "label", "_s").first()[0]
            return m
        return regression_metrics(scored, "label", "prediction").first().asDict()

    board = [("baseline", "trained", score(test.withColumn("prediction", baseline_prediction(train, "label", task))))]
    models: dict[str, PipelineModel] = {}
    prep, points = fit_stages(stages, train) if large else (Pipeline(stages=stages).fit(train), [])
    cells = find_cells(split, prep, points, n_classes) if large and CELL_MODELS & {*(only or CELL_MODELS)} else None
    if large and (cells or not CELL_MODELS & {*(only or CELL_MODELS)}):  # the linear fits hold their own blocks of rows
        train_x = train.select(features_of(prep).alias("features"), "label", "weight")
    else:
        train_x = prep.transform(train).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    for name, est in candidates(task, n_train, n_classes, trees, rounds).items():
        if only is not None and name not in only:
            continue
        if est is None:
            board.append((name, "skipped", {}))
            continue
        by_cell = cells is not None and name in CELL_MODELS
        model = PipelineModel(stages=[*prep.stages, fit_cells(est, cells, train, n_classes) if by_cell else est.fit(train_x)])
        models[name] = model
        board.append((name, "trained", score(cell_scores(model, cells, test, n_classes) if by_cell else model.transform(test))))
    train_x.unpersist()
    schema = "model string, status string, metrics map<string,double>"
    return local_table(spark, board, schema), models, split


def select_model(board: DataFrame, task: str) -> DataFrame:
    """(model, improved_over_baseline): F1, recall, precision; or RMSE, MAE, R2."""
    m = F.col("metrics")
    ok = board.where("status = 'trained'")
    base = ok.where("model = 'baseline'").select(
        m["f1"].alias("_bf1"), m["rmse"].alias("_brmse")
    )
    rest = ok.where("model <> 'baseline'").join(base, how="cross")
    if task == "classification":
        order = [m["f1"].desc(), m["recall"].desc(), m["precision"].desc(), F.col("model")]
        better = m["f1"] > F.col("_bf1")
    else:
        order = [m["rmse"], m["mae"], m["r2"].desc(), F.col("model")]
        better = m["rmse"] < F.col("_brmse")
    return rest.orderBy(*order).limit(1).select("model", "metrics", better.alias("improved_over_baseline"))


def feature_importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """(feature, importance) falling: tree importances or |coefficient|, four decimals."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "models"):  # one for each class
        values = sum(m.featureImportances.toArray() for m in last.models) / len(last.models)
    elif hasattr(last, "coefficients") and not hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficients.toArray())
    else:
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", f"f{a['idx']}") for group in attrs.values() for a in group}
    rows = [(names.get(i, f"f{i}"), round(float(v), 4)) for i, v in enumerate(values)]
    return local_table(scored.sparkSession, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _below(path: str) -> Column:
    """Pattern of a folder at the start of a listed path, whatever its scheme is spelled like."""
    return F.lit("^.*?" + re.escape(urlsplit(path).path.rstrip("/")))


def artifact_digest(spark: SparkSession, path: str) -> Row:
    """(files, bytes, digest) of a saved folder: equal for equal files under equal relative names, in whatever order they are listed."""
    files = scan_files(spark, path, list_files(spark, path)).select("path", "sha256").join(list_files(spark, path), "path")
    inside = F.regexp_replace(F.col("path"), _below(path), F.lit(""))
    return files.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
        F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", inside, "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"),
    ).first()


def save_and_verify(model: PipelineModel, sample: DataFrame, path: str, rows: int = 2) -> DataFrame:
    """Write the model, load it again and predict some rows with both: (label, prediction, reloaded, digest).

    Refuses an artefact whose digest changed while it was read, and a count of predictions other than that of the rows.
    """
    spark = sample.sparkSession
    model.write().overwrite().save(path)
    before = artifact_digest(spark, path)
    some = checkpoint_cut(sample.limit(rows).withColumn("_sample", F.monotonically_increasing_id()))
    own = model.transform(some).select("_sample", "label", "prediction")
    again = PipelineModel.load(path).transform(some).select("_sample", F.col("prediction").alias("reloaded"))
    out = checkpoint_cut(own.join(again, "_sample").select("label", "prediction", "reloaded", F.lit(before["digest"]).alias("digest")))
    if artifact_digest(spark, path) != before:
        raise ValueError(f"the model under '{path}' changed while it was read")
    if out.count() != some.count():
        raise ValueError(f"{out.count()} predictions for {some.count()} rows")
    return out


def model_status(
    df: DataFrame, profile: DataFrame, row_id: str, preferred: str | None = None, min_rows: int = V.MIN_MODEL_ROWS,
    min_class: int = V.MIN_CLASS_ROWS, trees: int = TREES, rounds: int = 100, only: list[str] | None = None,
) -> dict:
    """The whole modelling step as one outcome record.

    Status: unsupported, invalid_target, insufficient_data, leakage_detected or trained.
    """
    profile = settle(profile)  # else every use below scans the table again
    picked = pick_target(profile, preferred).first()
    if picked is None:
        return {"status": "unsupported", "reason": "No valid target candidate identified in dataset"}
    target = picked["target"]
    out = {"target": target, "why": picked["why"]}
    task, subtype, status = task_type(picked["dtype_inferred"], picked["unique_count"], picked["n_rows"] - picked["null_count"])
    if status != "ready":
        return {**out, "status": "invalid_target", "reason": status}
    out.update(task=task, subtype=subtype)
    enough = check_sufficiency(df, target, task, min_rows, min_class).first()
    if not enough["ok"]:
        return {**out, "status": enough["code"], "reason": f"{enough['rows']} usable rows"}
    audit = leakage_audit(df, profile, target)
    features = [r["column"] for r in audit.where("exclusion_status = 'retained'").orderBy("ordinal").collect()]
    types = {f.name: f.dataType for f in df.schema.fields}
    features = [c for c in features if not isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    out["audit"] = audit
    if not features:
        return {**out, "status": "leakage_detected", "reason": "no usable feature is left"}
    board, models, split = train_models(df, target, features, task, row_id, trees, rounds, only)
    best = select_model(board, task).first()
    scored = models[best["model"]].transform(split.where("is_test"))
    sizes = {r["is_test"]: r["n"] for r in split.groupBy("is_test").agg(F.count("*").alias("n")).collect()}
    return {
        **out, "status": "trained", "features": features, "leaderboard": board, "selected_model": best["model"],
        "metrics": best["metrics"], "improved_over_baseline": best["improved_over_baseline"],
        "importance": feature_importance(models[best["model"]], scored), "model": models[best["model"]], "split": split,
        "train_rows": sizes.get(False, 0), "test_rows": sizes.get(True, 0),
    }

