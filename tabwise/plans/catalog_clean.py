"""Queries: cleaning, sidecars, reconstruction."""

from pyspark.sql import functions as F

from tabwise.functions.exprs import normalize_category, parse_bool, strip_number
from tabwise.operators import clean as K, dates as D, profile as P
from tabwise.plans.registry import query, table, view
from tabwise.plans.views import COPIES, GAPPY, TEXTS
from tabwise.session import checkpoint_cut, local_table

_KEY = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query(f"SELECT min(_row_id) AS _row_id, {_KEY} FROM ({COPIES}) GROUP BY {_KEY}")
def dedupe_keep_first(spark, d):
    return K.drop_duplicates(view(spark, d, COPIES))[0]


@query(f"""SELECT _row_id, {_KEY}, _row_id AS _orig_row_index FROM ({COPIES})
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY _row_id) > 1""")
def dedupe_sidecar(spark, d):
    return K.drop_duplicates(view(spark, d, COPIES))[1]


@query(f"SELECT _row_id, TRY_CAST(trim(regexp_replace(money, '[$€£₹¥%,]', '', 'g')) AS DOUBLE) AS money FROM ({TEXTS})")
def coerce_money(spark, d):
    return view(spark, d, TEXTS).select("_row_id", strip_number(F.col("money")).alias("money"))


@query(f"""SELECT _row_id, CASE WHEN lower(trim(flag)) IN ('true', '1', 'yes', 't', 'y') THEN true WHEN lower(trim(flag)) IN ('false', '0', 'no', 'f', 'n') THEN false END AS flag
FROM ({TEXTS})""")
def coerce_bool(spark, d):
    return view(spark, d, TEXTS).select("_row_id", parse_bool(F.col("flag")).alias("flag"))


@query(f"SELECT _row_id, nullif(nullif(trim(priority), 'nan'), 'None') AS priority, nullif(nullif(trim(mostly_number), 'nan'), 'None') AS mostly_number FROM ({TEXTS})")
def coerce_category(spark, d):
    return view(spark, d, TEXTS).select(
        "_row_id", normalize_category(F.col("priority")).alias("priority"), normalize_category(F.col("mostly_number")).alias("mostly_number")
    )


@query(f"""SELECT _row_id, TRY_CAST(trim(regexp_replace(money, '[$€£₹¥%,]', '', 'g')) AS BIGINT) AS money, lower(flag) = 'yes' AS flag, trim(priority) AS priority, code_text
FROM ({TEXTS})""")
def coerce_table(spark, d):
    df = view(spark, d, TEXTS).select("_row_id", "money", "flag", "priority", "code_text")
    return K.coerce_types(df, P.profile_columns(df).collect())[0]


@query(f"SELECT _row_id, strftime(strptime(day_first, '%d/%m/%Y'), '%Y-%m-%d') AS day_first, iso FROM ({TEXTS})")
def normalize_dates(spark, d):
    df = view(spark, d, TEXTS)
    dates = D.resolve_dates(df.select("_row_id", "day_first", "iso")).collect()
    return K.normalize_dates(df.select("_row_id", "day_first", "iso"), dates)[0]


@query(f"SELECT _row_id, vague FROM ({TEXTS})")
def preserve_ambiguous(spark, d):
    df = view(spark, d, TEXTS).select("_row_id", "vague")
    return K.normalize_dates(df, D.resolve_dates(df).collect())[0]


_FILL = f"""WITH v AS ({GAPPY}), s AS (SELECT
CASE WHEN abs(skewness(price)) > 1 THEN quantile_cont(price, 0.5) ELSE avg(price) END AS price,
CASE WHEN abs(skewness(skewed)) > 1 THEN quantile_cont(skewed, 0.5) ELSE avg(skewed) END AS skewed,
round(CASE WHEN abs(skewness(whole)) > 1 THEN quantile_cont(whole, 0.5) ELSE avg(whole) END) AS whole FROM v)"""


@query(f"""{_FILL} SELECT v._row_id, round(coalesce(v.price, s.price), 4) AS price, round(coalesce(v.skewed, s.skewed), 4) AS skewed,
CAST(coalesce(v.whole, s.whole) AS BIGINT) AS whole FROM v, s""")
def impute_numeric(spark, d):
    df = view(spark, d, GAPPY).select("_row_id", "price", "skewed", "whole")
    out, _, _ = K.impute(df, P.profile_columns(df).collect(), [])
    return out.select("_row_id", F.round("price", 4).alias("price"), F.round("skewed", 4).alias("skewed"), "whole")


@query(f"""{_FILL}, n AS (SELECT count(*) AS n, count(price) AS p, count(skewed) AS k, count(whole) AS w FROM v)
SELECT 'price' AS "column", CASE WHEN abs((SELECT skewness(price) FROM v)) > 1 THEN 'median' ELSE 'mean' END AS method, n - p AS missing, round(s.price, 3) AS value FROM s, n
UNION ALL SELECT 'skewed', CASE WHEN abs((SELECT skewness(skewed) FROM v)) > 1 THEN 'median' ELSE 'mean' END, n - k, round(s.skewed, 3) FROM s, n
UNION ALL SELECT 'whole', CASE WHEN abs((SELECT skewness(whole) FROM v)) > 1 THEN 'median' ELSE 'mean' END, n - w, round(s.whole, 3) FROM s, n""")
def impute_numeric_facts(spark, d):
    facts = K.numeric_fill_facts(view(spark, d, GAPPY), ["price", "skewed", "whole"])
    rows = [(c, f["method"], f["missing"], round(float(f["value"]), 3)) for c, f in facts.items()]
    return local_table(spark, rows, "column string, method string, missing long, value double")


_BLANK = "({c} IS NULL OR trim({c}) = '' OR lower({c}) IN ('nan', 'none'))"


@query(f"""WITH v AS ({GAPPY}), s AS (SELECT
CASE WHEN round(count(*) FILTER ({_BLANK.format(c='priority')}) / count(*) * 100, 2) <= 30 THEN (SELECT priority FROM v WHERE NOT {_BLANK.format(c='priority')} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE 'Unknown' END AS p,
CASE WHEN round(count(*) FILTER ({_BLANK.format(c='state')}) / count(*) * 100, 2) <= 30 THEN (SELECT state FROM v WHERE NOT {_BLANK.format(c='state')} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE 'Unknown' END AS t FROM v)
SELECT _row_id, CASE WHEN {_BLANK.format(c='priority')} THEN s.p ELSE priority END AS priority, CASE WHEN {_BLANK.format(c='state')} THEN s.t ELSE state END AS state FROM v, s""")
def impute_categorical(spark, d):
    df = view(spark, d, GAPPY).select("_row_id", "priority", "state")
    return K.impute(df, P.profile_columns(df).collect(), [])[0]


@query(f"""WITH v AS ({GAPPY}) SELECT 'price' AS "column", _row_id, CAST(NULL AS VARCHAR) AS raw FROM v WHERE price IS NULL
UNION ALL SELECT 'priority', _row_id, priority FROM v WHERE {_BLANK.format(c='priority')}
UNION ALL SELECT 'state', _row_id, state FROM v WHERE {_BLANK.format(c='state')}""")
def null_cells(spark, d):
    df = view(spark, d, GAPPY).select("_row_id", "price", "priority", "state")
    return K.impute(df, P.profile_columns(df).collect(), [])[1]


# Line items with a fifty-fold price now and then.
SPIKES = """SELECT l_orderkey * 10 + l_linenumber AS _row_id, l_quantity, l_tax,
CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price FROM lineitem"""
_BOUNDS = f"""WITH v AS ({SPIKES}), q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM v),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query(f"{_BOUNDS} SELECT 'price' AS \"column\", _row_id, price AS value FROM v, b WHERE price < lo OR price > hi")
def flag_outliers(spark, d):
    df = view(spark, d, SPIKES)
    return K.outlier_cells(df, K.outlier_bounds(df, ["l_quantity", "l_tax", "price"]))


@query(f"""{_BOUNDS} SELECT 'price' AS "column", round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(iqr), 4) AS iqr, round(any_value(lo), 4) AS lower_bound,
round(any_value(hi), 4) AS upper_bound, count(*) FILTER (price < lo OR price > hi) AS outlier_count, round(count(*) FILTER (price < lo OR price > hi) / count(price) * 100, 2) AS outlier_pct FROM v, b""")
def outlier_counts(spark, d):
    df = view(spark, d, SPIKES)
    # small_rows=0: the quartiles take the path meant for tables of any size
    return K.outlier_summary(df, K.outlier_bounds(df, ["l_quantity", "l_tax", "price"], small_rows=0))


# A table with every kind of dirt at once: copies, text numbers, flags, dates, gaps.
MESS = f"""SELECT t._row_id * 2 AS _row_id, t.money, t.flag, t.day_first, t.vague, t.priority AS padded, t.mostly_number, CASE WHEN t._row_id % 7 = 0 THEN NULL ELSE t._row_id / 4.0 END AS amount_x
FROM ({TEXTS}) t
UNION ALL
SELECT t._row_id * 2 + 1, t.money, t.flag, t.day_first, t.vague, t.priority, t.mostly_number, CASE WHEN t._row_id % 7 = 0 THEN NULL ELSE t._row_id / 4.0 END FROM ({TEXTS}) t WHERE t._row_id % 50 = 0"""
MESS = MESS.replace("t._row_id / 4.0", "CAST(t._row_id AS DOUBLE) / 4.0")


def _mess(spark, d):
    df = view(spark, d, MESS)
    counts = checkpoint_cut(P.value_counts(df))  # one pass serves types, labels and dates
    return df, K.clean(df, P.profile_columns(df, counts=counts), D.resolve_dates(df, counts=counts))


@query(MESS)
def reconstruct(spark, d):
    df, c = _mess(spark, d)
    return K.reconstruct(c.table, c.removed, c.raw_cells, df.schema)


@query(f"""WITH v AS ({MESS}), k AS (SELECT min(_row_id) AS r, * EXCLUDE (_row_id) FROM v GROUP BY ALL), n AS (SELECT (SELECT count(*) FROM v) AS a, (SELECT count(*) FROM k) AS b),
x AS (SELECT 'money' AS c, CAST(substr(money, 2) AS DOUBLE) AS x FROM k UNION ALL SELECT 'amount_x', coalesce(amount_x, (SELECT CASE WHEN abs(skewness(amount_x)) > 1 THEN quantile_cont(amount_x, 0.5) ELSE avg(amount_x) END FROM k)) FROM k),
e AS (SELECT c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY 1), o AS (SELECT c FROM x JOIN e USING (c) WHERE q3 > q1 GROUP BY 1 HAVING count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) > 0)
SELECT step_no, "column", method, CAST(missing_count AS BIGINT) AS missing_count FROM (
SELECT 1 AS step_no, 'ALL_COLUMNS' AS "column", 'drop_duplicates' AS method, 0 AS missing_count FROM n WHERE a > b
UNION ALL SELECT 2, c, 'type_coercion', 0 FROM (VALUES ('money'), ('flag'), ('padded'), ('amount_x')) t(c)
UNION ALL SELECT 3, 'day_first', 'normalize_date', (SELECT count(*) FILTER (day_first IS NULL) FROM k)
UNION ALL SELECT 3, 'vague', 'normalize_date', (SELECT count(*) FILTER (vague IS NULL) FROM k)
UNION ALL SELECT 4, 'mostly_number', 'constant_unknown', (SELECT count(*) FILTER (mostly_number = 'nan') FROM k)
UNION ALL SELECT 4, 'amount_x', (SELECT CASE WHEN abs(skewness(amount_x)) > 1 THEN 'median' ELSE 'mean' END FROM k), (SELECT count(*) FILTER (amount_x IS NULL) FROM k)
UNION ALL SELECT 5, c, 'flag_outliers_iqr', 0 FROM o)""")
def cleaning_log(spark, d):
    _, c = _mess(spark, d)
    return c.log.select("step_no", "column", "method", "missing_count")


@query(f"""WITH v AS ({MESS}), k AS (SELECT DISTINCT * EXCLUDE (_row_id) FROM v)
SELECT (SELECT count(*) FROM v) AS rows_before, (SELECT count(*) FROM k) AS rows_after, CAST(7 AS INTEGER) AS cols_before, CAST(7 AS INTEGER) AS cols_after,
(SELECT count(*) FROM v) - (SELECT count(*) FROM k) AS duplicates_removed""")
def before_after(spark, d):
    df, c = _mess(spark, d)
    return K.before_after(df, c).drop("content_sum")


@query()
def fingerprint(spark, d):
    return K.fingerprint(table(spark, d, "lineitem"))


@query("""WITH v AS (SELECT count(*) AS n, count(price) AS a, count(state) AS b FROM (""" + GAPPY + """))
SELECT 'price' AS "column", round(a / n * 100, 1) AS completeness FROM v UNION ALL SELECT 'state', round(b / n * 100, 1) FROM v""")
def completeness(spark, d):
    from tabwise.operators.charts import completeness as complete

    return complete(view(spark, d, GAPPY).select("price", "state")).select("column", "completeness")
