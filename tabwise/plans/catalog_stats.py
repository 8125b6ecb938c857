"""Queries: summaries, correlations, chart data."""

from pyspark.sql import functions as F

from tabwise.operators import charts as C, profile as P, stats as S
from tabwise.plans.registry import each, query, table, view
from tabwise.plans.views import CLIENTS, GAPPY, PEOPLE, PEOPLE_COLUMNS
from tabwise.session import local_table

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SUMMARY = """SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct,
round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median,
round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM {t}"""


@query(each(_LINE, _SUMMARY.replace("{t}", "lineitem")))
def numeric_summary(spark, d):
    return S.numeric_summary(table(spark, d, "lineitem"), _LINE)


@query(f"WITH v AS ({GAPPY})\n" + each(["price", "skewed"], _SUMMARY.replace("{t}", "v")))
def numeric_summary_gaps(spark, d):
    return S.numeric_summary(view(spark, d, GAPPY), ["price", "skewed"], small_rows=0)


@query(each(_LINE, "SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.999), 6) AS p999, min({c}) AS p0, max({c}) AS p1 FROM lineitem"))
def exact_quantiles(spark, d):
    from tabwise.operators.quantiles import exact_quantiles as quantiles

    # small_rows=0 takes the banded path that suits tables of any size
    got = quantiles(table(spark, d, "lineitem"), _LINE, [0.01, 0.5, 0.999, 0.0, 1.0], small_rows=0)
    rows = [(c, round(v[0], 6), round(v[1], 6), round(v[2], 6), v[3], v[4]) for c, v in got.items()]
    return local_table(spark, rows, "column string, p01 double, p50 double, p999 double, p0 double, p1 double")


_ORD = ["o_orderstatus", "o_orderpriority"]


@query(f"WITH v AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat(' ', o_orderpriority) END AS o_orderpriority FROM orders)\n" + each(_ORD, """SELECT '{c}' AS "column", count(*) FILTER (trim({c}) <> '') AS count, count(DISTINCT trim({c})) AS unique_count, count(*) - count({c}) AS null_count,
round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, (SELECT trim({c}) FROM v WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_category,
(SELECT count(*) FROM v WHERE {c} IS NOT NULL GROUP BY trim({c}) ORDER BY 1 DESC LIMIT 1) AS top_category_freq,
(SELECT string_agg(t || '=' || n, ', ' ORDER BY n DESC, t) FROM (SELECT trim({c}) AS t, count(*) AS n FROM v WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_categories FROM v"""))
def categorical_summary(spark, d):
    v = view(spark, d, "SELECT o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat(' ', o_orderpriority) END AS o_orderpriority FROM orders")
    told = F.transform("top_categories", lambda e: F.concat_ws("=", e["value"], e["n"].cast("string")))
    return S.categorical_summary(v, _ORD).withColumn("top_categories", F.array_join(told, ", "))


@query(each(["p_brand", "p_type"], """SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS place, {c} AS value, count(*) AS n FROM part GROUP BY {c}) WHERE place <= 5"""))
def top_values(spark, d):
    return S.top_values(S.categorical_counts(table(spark, d, "part"), ["p_brand", "p_type"]))


@query(f"WITH v AS ({PEOPLE})\n" + each(PEOPLE_COLUMNS, """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, CASE WHEN '{c}' IN ('col_a', 'col_b', 'col_c', 'col_d') THEN NULL ELSE (SELECT {c} FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS top_category FROM v"""))
def hidden_categories(spark, d):
    df = view(spark, d, PEOPLE)
    hidden = S.sensitive_names(P.profile_columns(df).collect())
    return S.categorical_summary(df, PEOPLE_COLUMNS, hidden).select("column", "unique_count", "top_category")


@query("""SELECT 'numeric' AS kind, c AS "column" FROM (VALUES ('customer_id'), ('balance'), ('nation_no')) t(c) WHERE (SELECT count(*) FROM customer) > 0
UNION ALL SELECT 'categorical', c FROM (VALUES ('email'), ('full_name'), ('segment')) t(c) WHERE (SELECT count(*) FROM customer) > 0""")
def summary_dispatch(spark, d):
    df = view(spark, d, CLIENTS)
    a, b = S.dataset_summary(df, P.profile_columns(df).collect())
    return a.select(F.lit("numeric").alias("kind"), "column").unionByName(b.select(F.lit("categorical").alias("kind"), "column"))


# A constant column, an identifier and gaps: which columns may be correlated?
MIXED = "SELECT c_custkey AS customer_id, c_acctbal AS balance, c_nationkey AS nation_no, 5 AS fixed_no, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 + c_nationkey END AS partly FROM customer"


@query(f"""WITH v AS ({MIXED}) SELECT 'balance' AS "column" FROM v HAVING stddev_samp(balance) > 0 UNION ALL SELECT 'nation_no' FROM v HAVING stddev_samp(nation_no) > 0
UNION ALL SELECT 'fixed_no' FROM v HAVING stddev_samp(fixed_no) > 0 UNION ALL SELECT 'partly' FROM v HAVING stddev_samp(partly) > 0""")
def eligible_numeric(spark, d):
    df = view(spark, d, MIXED)
    return local_table(spark, [(c,) for c in S.eligible_numeric(df, P.profile_columns(df).collect())], "column string")


def _pairs_sql(cols, source, corr):
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, round({corr.format(a=a, b=b)}, 6) AS r FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    )


@query(_pairs_sql(_LINE, "lineitem", "corr({a}, {b})"))
def pearson_pairs(spark, d):
    return S.pearson_pairs(table(spark, d, "lineitem"), _LINE).select("col1", "col2", F.round("r", 6).alias("r"))


_GAPS3 = ["price", "whole", "o_custkey"]


@query(f"WITH v AS ({GAPPY})\n" + _pairs_sql(_GAPS3, "v", "corr({a}, {b})"))
def pearson_gaps(spark, d):
    return S.pearson_pairs(view(spark, d, GAPPY), _GAPS3).select("col1", "col2", F.round("r", 6).alias("r"))


def _ranks(cols, source):
    return "SELECT " + ", ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) AS {c}" for c in cols) + f" FROM {source}"


@query(f"WITH k AS ({_ranks(_LINE, 'lineitem')})\n" + _pairs_sql(_LINE, "k", "corr({a}, {b})"))
def spearman_pairs(spark, d):
    return S.spearman_pairs(table(spark, d, "lineitem"), _LINE).select("col1", "col2", F.round("r", 6).alias("r"))


@query(f"""WITH v AS ({GAPPY}), c AS (SELECT price, o_custkey FROM v WHERE price IS NOT NULL AND o_custkey IS NOT NULL), k AS ({_ranks(['price', 'o_custkey'], 'c')})
SELECT 'price' AS col1, 'o_custkey' AS col2, round(corr(price, o_custkey), 6) AS r FROM k""")
def spearman_gaps(spark, d):
    return S.spearman_pairs(view(spark, d, GAPPY), ["price", "o_custkey"]).select("col1", "col2", F.round("r", 6).alias("r"))


@query("""SELECT l_quantity AS value, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1""")
def average_ranks(spark, d):
    from tabwise.operators.quantiles import average_ranks as ranks

    return ranks(table(spark, d, "lineitem"), "l_quantity")


@query(f"SELECT col1, col2, round(r, 4) AS pearson_r, round(abs(r), 4) AS abs_r FROM ({_pairs_sql(_LINE, 'lineitem', 'corr({a}, {b})')})")
def top_pairs(spark, d):
    return S.top_pairs(S.pearson_pairs(table(spark, d, "lineitem"), _LINE)).select("col1", "col2", "pearson_r", "abs_r")


_SQUARE = " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, {'1.0' if a == b else f'round(corr({a}, {b}), 4)'} AS r FROM lineitem" for a in _LINE for b in _LINE
)


@query(f"SELECT DISTINCT * FROM ({_SQUARE})")
def heatmap(spark, d):
    m = S.correlation_matrix(S.pearson_pairs(table(spark, d, "lineitem"), _LINE), _LINE)
    return m.select("col1", "col2", F.col("r").cast("double").alias("r"))


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def hist(spark, d):
    return C.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "n")


@query("""WITH r AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT position, event_id, value FROM r WHERE position % greatest(1, n // 500) = 0""")
def trend(spark, d):
    return C.trend(table(spark, d, "events"), "ts", "value", "event_id", points=500).select("position", "event_id", "value")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def trend_by_month(spark, d):
    return C.trend_by_period(table(spark, d, "orders"), "o_orderdate", "o_totalprice").select(
        F.col("period").cast("timestamp_ntz").alias("period"), "n", F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total")
    )


@query("SELECT o_orderkey, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders WHERE o_totalprice IS NOT NULL ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000")
def scatter_sample(spark, d):
    return C.scatter_sample(table(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey", points=1000)


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(o_orderpriority) FROM orders) * 100, 2) AS pct FROM orders GROUP BY 1")
def category_frequency(spark, d):
    return C.category_frequency(table(spark, d, "orders"), "o_orderpriority")


_BOX = """WITH q AS (SELECT {g} AS "group", quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
j AS (SELECT q.*, o.o_totalprice AS x, o.o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders o JOIN q ON q."group" = {o})
SELECT "group", count(x) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
min(x) FILTER (inside) AS low_whisker, max(x) FILTER (inside) AS high_whisker, count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY 1"""


def _r4(df):
    return df.select("group", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "low_whisker", "high_whisker", "outliers")


@query(_BOX.format(g="o_orderpriority", o="o.o_orderpriority"))
def box_by_group(spark, d):
    return _r4(C.box_plot(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"))


@query(_BOX.format(g="'all'", o="'all'"))
def box_plot(spark, d):
    return _r4(C.box_plot(table(spark, d, "orders"), "o_totalprice"))


@query("SELECT o_orderstatus AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS pct FROM orders GROUP BY 1")
def target_distribution(spark, d):
    return C.target_distribution(table(spark, d, "orders"), "o_orderstatus", True)


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def target_histogram(spark, d):
    """A target of many values is shown as a histogram."""
    return C.target_distribution(table(spark, d, "orders"), "o_totalprice", False).select("bin", "n")


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 40 AS w FROM lineitem),
c AS (SELECT l_returnflag AS "group", CAST(least(floor((l_extendedprice - lo) / w), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1, 2)
SELECT "group", bin, n, round(n / (sum(n) OVER (PARTITION BY "group") * w), 10) AS density FROM c, b""")
def violin_density(spark, d):
    return C.violin_density(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag").select("group", "bin", "n", F.round("density", 10).alias("density"))


@query("""WITH s AS (SELECT l_returnflag AS g, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, stddev_samp(l_extendedprice) AS sd,
quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
b AS (SELECT *, 1.059 * least(sd, (q3 - q1) / 1.349) * pow(n, -0.2) AS h FROM s),
c AS (SELECT *, lo - 2 * h AS low, greatest(128, least(4096, ceil((hi - lo + 4 * h) / (h / 4)))) AS cells FROM b), d AS (SELECT *, (hi - lo + 4 * h) / cells AS step FROM c),
p AS (SELECT d.g, least(floor((l_extendedprice - low) / step), cells - 1) AS k, (l_extendedprice - low) / step AS pos FROM lineitem JOIN d ON l_returnflag = d.g),
w AS (SELECT g, k, sum(w) AS w FROM (SELECT g, k, 1 - (pos - k) AS w FROM p UNION ALL SELECT g, k + 1, pos - k FROM p) GROUP BY ALL),
j AS (SELECT d.*, unnest(range(CAST(cells AS BIGINT) + 1)) AS point FROM d),
f AS (SELECT j.g, point, sum(w * exp(-0.5 * pow((point - k) * step / h, 2))) AS mass FROM j JOIN w ON w.g = j.g AND abs(point - k) <= ceil(6 * h / step) GROUP BY ALL),
o AS (SELECT d.g, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN d ON l_returnflag = d.g GROUP BY 1)
SELECT j.g AS "group", CAST(j.point AS INTEGER) AS point, round(low + j.point * step, 4) AS "at", round(coalesce(mass, 0) / (n * h * sqrt(2 * pi())), 12) AS density, round(h, 6) AS bandwidth,
n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, outliers FROM j LEFT JOIN f ON f.g = j.g AND f.point = j.point JOIN o ON o.g = j.g""")
def violin(spark, d):
    out = C.violin(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    digits = {"at": 4, "density": 12, "bandwidth": 6, "q1": 4, "median": 4, "q3": 4}
    return out.withColumns({c: F.round(c, k) for c, k in digits.items()}).drop("low_whisker", "high_whisker")


@query("""SELECT CAST(place AS INTEGER) AS place, chart_type, x_col, y_col FROM (VALUES (1, 'scatter', 'balance', 'nation_no'), (2, 'histogram', 'balance', NULL), (3, 'histogram', 'nation_no', NULL),
(4, 'categorical_bar', 'segment', NULL), (5, 'boxplot', 'segment', 'balance'), (6, 'target_distribution', NULL, 'segment')) t(place, chart_type, x_col, y_col)
WHERE (SELECT count(DISTINCT c_mktsegment) FROM customer) BETWEEN 2 AND 10""")
def chart_plan(spark, d):
    df = view(spark, d, CLIENTS)
    return C.chart_plan(df, P.profile_columns(df).orderBy("ordinal").collect()).select("place", "chart_type", "x_col", "y_col")


@query(f"WITH v AS ({GAPPY})\n" + each(["priority", "state"], "SELECT '{c}' AS name FROM v HAVING count(DISTINCT {c}) BETWEEN 2 AND 10 AND (count(*) - count({c})) / count(*) < 0.2"))
def target_candidates(spark, d):
    return P.profile_columns(view(spark, d, GAPPY)).where("is_target_candidate").select("name")
