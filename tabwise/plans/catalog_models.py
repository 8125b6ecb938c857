"""Queries: targets, leakage, splits, metrics, models."""

from pyspark.sql import functions as F

from tabwise.functions import fixed as V
from tabwise.operators import models as M, profile as P
from tabwise.plans.catalog_ask import WORDS, words
from tabwise.plans.registry import query, table, view
from tabwise.plans.views import CLIENTS
from tabwise.session import local_table

# Line items with a derived outcome, a copy of it and a leaky number.
CASES = """SELECT l_orderkey * 10 + l_linenumber AS _row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
l_extendedprice * 2 + 1 AS shadow, concat('x', l_returnflag) AS flag_copy, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS churn FROM lineitem"""


@query("SELECT 'segment' AS target, 'single candidate' AS why FROM customer HAVING count(DISTINCT c_mktsegment) BETWEEN 2 AND 10 AND count(DISTINCT c_nationkey) > 10")
def target_pick(spark, d):
    return M.pick_target(P.profile_columns(view(spark, d, CLIENTS))).select("target", "why")


@query("SELECT 'nation_no' AS target, 'preferred' AS why FROM customer HAVING count(*) > 0")
def target_preferred(spark, d):
    return M.pick_target(P.profile_columns(view(spark, d, CLIENTS)), "nation_no").select("target", "why")


@query("""SELECT 'o_orderstatus' AS target, 'classification' AS task, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary' ELSE 'multiclass' END AS subtype FROM orders
UNION ALL SELECT 'o_orderpriority', 'classification', CASE WHEN count(DISTINCT o_orderpriority) = 2 THEN 'binary' ELSE 'multiclass' END FROM orders
UNION ALL SELECT 'o_totalprice', 'regression', 'continuous' FROM orders HAVING count(DISTINCT o_totalprice) > 10
UNION ALL SELECT 'o_custkey', 'regression', 'continuous' FROM orders HAVING count(DISTINCT o_custkey) > 10
UNION ALL SELECT 'o_orderdate', 'regression', 'continuous' FROM orders HAVING count(DISTINCT o_orderdate) > 10""")
def task_types(spark, d):
    rows = P.profile_columns(table(spark, d, "orders").withColumnRenamed("o_orderkey", "_row_id")).collect()
    got = [(r["name"], *M.task_type(r["dtype_inferred"], r["unique_count"], r["n_rows"] - r["null_count"])[:2]) for r in rows]
    return local_table(spark, got, "target string, task string, subtype string")


@query("""WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1)
SELECT class, n, round(n / (SELECT sum(n) FROM c) * 100, 2) AS pct, round((SELECT max(n) FROM c) / greatest(1, (SELECT min(n) FROM c)), 2) AS imbalance_ratio FROM c""")
def class_balance(spark, d):
    return M.class_balance(table(spark, d, "orders"), "o_orderstatus")


@query("""SELECT true AS ok, 'ready' AS code, count(*) AS rows, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(skewness(o_totalprice), 4) AS skewness
FROM orders HAVING count(*) >= 30""")
def sufficiency_regression(spark, d):
    return M.check_sufficiency(table(spark, d, "orders"), "o_totalprice", "regression").select("ok", "code", "rows", "mean", "std", "skewness")


@query("""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT sum(n) >= 30 AND count(*) >= 2 AND min(n) >= 5 AS ok, CAST(sum(n) AS BIGINT) AS rows, count(*) AS n_classes, min(n) AS min_class FROM c""")
def sufficiency_classes(spark, d):
    return M.check_sufficiency(table(spark, d, "orders"), "o_orderstatus", "classification").select("ok", "rows", "n_classes", "min_class")


_POST = " OR ".join(f"regexp_matches(name, '{p}')" for p in V.POST_OUTCOME)


@query(f"SELECT name, ({_POST}) AS post_outcome FROM ({WORDS})")
def leakage_names(spark, d):
    from tabwise.functions.exprs import is_post_outcome

    return words(spark, d).select("name", is_post_outcome(F.col("name")).alias("post_outcome"))


_NUM = ["l_quantity", "l_discount", "l_tax", "shadow"]


@query(f"WITH v AS ({CASES})\n" + "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", round(abs(corr({c}, l_extendedprice)), 6) AS measured FROM v" for c in _NUM))
def leakage_pearson(spark, d):
    return M.leakage_pearson(view(spark, d, CASES), "l_extendedprice", _NUM).select("column", F.round("measured", 6).alias("measured"))


def _nmi(c):
    return f"""SELECT '{c}' AS "column", round(CASE WHEN hx + hy - hxy <= 1e-12 THEN 0 ELSE (hx + hy - hxy) / ((hx + hy) / 2) END, 6) AS measured FROM (SELECT
(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM v) AS p FROM v GROUP BY {c})) AS hx,
(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM v) AS p FROM v GROUP BY l_returnflag)) AS hy,
(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM v) AS p FROM v GROUP BY {c}, l_returnflag)) AS hxy)"""


_NOM = ["l_linestatus", "l_quantity", "flag_copy", "churn"]


@query(f"WITH v AS ({CASES})\n" + "\nUNION ALL\n".join(_nmi(c) for c in _NOM))
def leakage_nmi(spark, d):
    return M.leakage_nmi(view(spark, d, CASES), "l_returnflag", _NOM).select("column", F.round("measured", 6).alias("measured"))


@query(f"""WITH v AS ({CASES}), m AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, abs(corr(shadow, l_extendedprice)) AS s FROM v)
SELECT 'l_extendedprice' AS "column", 'target_identity' AS detection_method, 'excluded' AS exclusion_status, 'target_column' AS reason FROM m
UNION ALL SELECT 'l_quantity', 'pearson_correlation', CASE WHEN a >= 0.95 THEN 'excluded' ELSE 'retained' END, CASE WHEN a >= 0.95 THEN 'high_pearson_correlation_leakage' END FROM m
UNION ALL SELECT 'l_discount', 'pearson_correlation', CASE WHEN b >= 0.95 THEN 'excluded' ELSE 'retained' END, CASE WHEN b >= 0.95 THEN 'high_pearson_correlation_leakage' END FROM m
UNION ALL SELECT 'shadow', 'pearson_correlation', CASE WHEN s >= 0.95 THEN 'excluded' ELSE 'retained' END, CASE WHEN s >= 0.95 THEN 'high_pearson_correlation_leakage' END FROM m
UNION ALL SELECT 'l_returnflag', 'normalized_mutual_info', 'retained', NULL FROM m""")
def leakage_audit(spark, d):
    df = view(spark, d, CASES).select("_row_id", "l_extendedprice", "l_quantity", "l_discount", "shadow", "l_returnflag")
    return M.leakage_audit(df, P.profile_columns(df), "l_extendedprice").select("column", "detection_method", "exclusion_status", "reason")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR)))) <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test
FROM orders""")
def split_stratified(spark, d):
    return M.split_rows(table(spark, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "is_test")


# A rule that guesses the label of a document from its length.
SCORED = """SELECT l.doc_id, l.quality AS label, CASE WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS prediction, CAST(d.n_chars AS DOUBLE) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


@query(f"""WITH v AS ({SCORED}), c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = prediction) AS good, count(*) AS n FROM v)
SELECT round(good / n, 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""")
def clf_metrics(spark, d):
    return M.classification_metrics(view(spark, d, SCORED), "label", "prediction")


_GUESS = "SELECT o_orderstatus AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' ELSE 'P' END AS prediction FROM orders"


@query(f"""WITH v AS ({_GUESS}), k AS (SELECT label AS c FROM v UNION SELECT prediction FROM v),
s AS (SELECT c, (SELECT count(*) FROM v WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM v WHERE prediction = c) AS p, (SELECT count(*) FROM v WHERE label = c) AS a FROM k)
SELECT (SELECT round(count(*) FILTER (label = prediction) / count(*), 4) FROM v) AS accuracy, round(avg(coalesce(tp / nullif(p, 0), 0)), 4) AS precision,
round(avg(coalesce(tp / nullif(a, 0), 0)), 4) AS recall, round(avg(coalesce(2.0 * tp / nullif(p + a, 0), 0)), 4) AS f1 FROM s""")
def clf_metrics_many(spark, d):
    return M.classification_metrics(view(spark, d, _GUESS), "label", "prediction")


@query(f"SELECT CAST(label AS VARCHAR) AS actual, CAST(prediction AS VARCHAR) AS predicted, count(*) AS n FROM ({SCORED}) GROUP BY 1, 2")
def confusion(spark, d):
    return M.confusion(view(spark, d, SCORED), "label", "prediction")


@query(f"""WITH v AS ({SCORED}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM v)
SELECT round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 4) AS roc_auc FROM r""")
def roc_auc(spark, d):
    return M.roc_auc(view(spark, d, SCORED), "label", "score")


_FIT = "SELECT l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem"


@query(f"""WITH v AS ({_FIT}), m AS (SELECT avg(label) AS m FROM v)
SELECT round(avg(abs(label - prediction)), 4) AS mae, round(avg((label - prediction) * (label - prediction)), 2) AS mse, round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse,
round(1 - sum((label - prediction) * (label - prediction)) / sum((label - m) * (label - m)), 4) AS r2 FROM v, m""")
def reg_metrics(spark, d):
    return M.regression_metrics(view(spark, d, _FIT), "label", "prediction").select("mae", F.round("mse", 2).alias("mse"), "rmse", "r2")


_BOARD = """SELECT o_orderpriority AS model, 'trained' AS status, round(avg(o_totalprice), 4) AS rmse, round(avg(o_custkey), 4) AS mae, round(avg(o_orderkey) / 1000000.0, 6) AS r2 FROM orders GROUP BY 1
UNION ALL SELECT 'baseline', 'trained', round(avg(o_totalprice), 4), round(avg(o_custkey), 4), 0.0 FROM orders"""


@query(f"WITH b AS ({_BOARD}) SELECT model, rmse < (SELECT rmse FROM b WHERE model = 'baseline') AS improved_over_baseline FROM b WHERE model <> 'baseline' ORDER BY rmse, mae, r2 DESC LIMIT 1")
def select_model(spark, d):
    board = view(spark, d, _BOARD).select(
        "model", "status", F.create_map(*[x for c in ("rmse", "mae", "r2") for x in (F.lit(c), F.col(c).cast("double"))]).alias("metrics")
    )
    return M.select_model(board, "regression").select("model", "improved_over_baseline")


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


@query()
def leaderboard_classification(spark, d):
    board, _, _ = M.train_models(view(spark, d, CASES), "churn", _FEATURES, "classification", "_row_id")
    return board.select("model", "status", F.explode_outer("metrics").alias("metric", "value"))


@query()
def leaderboard_regression(spark, d):
    board, _, _ = M.train_models(view(spark, d, CASES), "l_extendedprice", _FEATURES, "regression", "_row_id")
    return board.select("model", "status", F.explode_outer("metrics").alias("metric", "value"))


@query()
def feature_importance(spark, d):
    _, models, split = M.train_models(view(spark, d, CASES), "l_extendedprice", _FEATURES, "regression", "_row_id", only=["random_forest"])
    return M.feature_importance(models["random_forest"], models["random_forest"].transform(split.where("is_test")))


@query("SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS predictions, CAST(ceil(count(*) * 0.2) AS BIGINT) AS equal, CAST(1 AS BIGINT) AS digests FROM lineitem")
def model_round_trip(spark, d):
    """All test rows predicted by a model and by the copy read back from its files."""
    from tabwise.plans.registry import scratch

    _, models, split = M.train_models(view(spark, d, CASES), "l_extendedprice", _FEATURES, "regression", "_row_id", only=["ridge"])
    test = split.where("is_test")
    out = M.save_and_verify(models["ridge"], test, scratch(spark, "model"), test.count())
    return out.agg(F.count("prediction").alias("predictions"), F.count_if(F.col("prediction") == F.col("reloaded")).alias("equal"), F.count_distinct("digest").alias("digests"))


@query()
def leaderboard_many_classes(spark, d):
    """Boosted trees for five classes, one model for each against the rest."""
    df = table(spark, d, "orders").withColumnRenamed("o_orderkey", "_row_id")
    board, _, _ = M.train_models(df, "o_orderpriority", ["o_totalprice", "o_orderstatus"], "classification", "_row_id", only=["boosted_trees"])
    return board.select("model", "status", F.explode_outer("metrics").alias("metric", "value"))


@query()
def model_status(spark, d):
    df = view(spark, d, CASES).drop("flag_copy", "shadow")
    out = M.model_status(df, P.profile_columns(df), "_row_id", "churn")
    return local_table(spark, [(out["status"], out.get("target"), out.get("task"), out.get("selected_model"))], "status string, target string, task string, selected_model string")


@query("""WITH r AS (SELECT quality AS q, n FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)) SELECT CAST((SELECT q FROM r ORDER BY n DESC, q LIMIT 1) AS DOUBLE) AS majority, round(avg(toxic), 6) AS mean FROM labels""")
def baselines(spark, d):
    labels = table(spark, d, "labels")
    one = local_table(spark, [(1,)], "x int")
    return one.select(
        M.baseline_prediction(labels.withColumn("label", F.col("quality").cast("double")), "label", "classification").alias("majority"),
        F.round(M.baseline_prediction(labels, "toxic", "regression"), 6).alias("mean"),
    )
