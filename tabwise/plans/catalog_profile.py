"""Queries: profile, personal data, labels, dates, quality."""

from pyspark.sql import functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import label_by_header, pii_by_header
from tabwise.operators import dates as D, profile as P
from tabwise.plans.catalog_ask import WORDS, words
from tabwise.plans.registry import each, first_match, lit_list, query, view
from tabwise.plans.views import CLIENTS, COPIES, GAPPY, PEOPLE, PEOPLE_COLUMNS, TEXT_COLUMNS, TEXTS

_COUNTED = ["o_custkey", "priority", "state", "whole"]


@query(f"WITH v AS ({GAPPY})\n" + each(_COUNTED, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n, min(_row_id) AS first_row FROM v GROUP BY 2"))
def value_counts(spark, d):
    return P.value_counts(view(spark, d, GAPPY), _COUNTED)


_GAP_COLUMNS = ["o_custkey", "o_orderkey", "price", "skewed", "whole", "priority", "state"]


@query(f"WITH v AS ({GAPPY})\n" + each(_GAP_COLUMNS, """SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS null_count,
round((count(*) - count({c})) / count(*), 4) AS null_pct, count(DISTINCT {c}) AS unique_count,
(count(DISTINCT {c}) <= 1 AND count(*) = count({c})) AS is_constant, count({c}) = 0 AS is_empty FROM v"""))
def profile_columns(spark, d):
    return P.profile_columns(view(spark, d, GAPPY)).select("name", "n_rows", "null_count", "null_pct", "unique_count", "is_constant", "is_empty")


@query(f"WITH v AS ({GAPPY})\n" + each(_GAP_COLUMNS, "SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS null_count FROM v"))
def approx_profile(spark, d):
    # the distinct counts are sketches, so only the exact part is compared
    return P.approx_profile(view(spark, d, GAPPY)).select("name", "n_rows", "null_count")


@query(f"""WITH g AS (SELECT count(*) AS n FROM ({COPIES}) GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) / sum(n), 4) AS duplicate_pct FROM g""")
def duplicate_rate(spark, d):
    return P.duplicate_rate(view(spark, d, COPIES))


_BOOLS = lit_list(V.BOOL_TRUE + V.BOOL_FALSE)
_NUM = "TRY_CAST(trim(regexp_replace({c}, '[$€£₹¥%,]', '', 'g')) AS DOUBLE)"
_FACTS = f"""SELECT '{{c}}' AS name, count({{c}}) AS n, count(*) FILTER (lower(trim({{c}})) NOT IN ({_BOOLS})) AS not_bool,
count(DISTINCT lower(trim({{c}}))) AS words, count(*) FILTER (regexp_matches({{c}}, '{V.DATE_LIKE}')) AS dates,
count({_NUM}) FILTER (NOT isnan({_NUM})) AS nums, count(*) FILTER (NOT isnan({_NUM}) AND {_NUM} % 1 <> 0) AS fracs, count(DISTINCT {{c}}) AS u FROM v"""


@query(f"WITH v AS ({TEXTS}), f AS (\n" + each(TEXT_COLUMNS, _FACTS) + """)
SELECT name, CASE WHEN n = 0 THEN 'string' WHEN not_bool = 0 AND words <= 2 THEN 'bool' WHEN dates / n >= 0.75 THEN 'date'
WHEN nums / n >= 0.9 AND fracs = 0 THEN 'int' WHEN nums / n >= 0.9 THEN 'float'
WHEN u <= 20 OR (u / n <= 0.05 AND u < 100) THEN 'category' ELSE 'string' END AS dtype_inferred, u AS unique_count FROM f""")
def infer_types(spark, d):
    return P.profile_columns(view(spark, d, TEXTS)).select("name", "dtype_inferred", "unique_count")


def _head(c, k):
    return f"SELECT '{c}' AS name, {c} AS v, row_number() OVER (ORDER BY _row_id) AS k FROM v WHERE {c} IS NOT NULL QUALIFY k <= {k}"


@query(f"WITH v AS ({TEXTS}), h AS (\n" + "\nUNION ALL\n".join(_head(c, 30) for c in TEXT_COLUMNS) + f""")
SELECT name, round(count(*) FILTER (regexp_matches(v, '{V.DATE_LIKE}')) / count(*), 4) AS date_share FROM h GROUP BY 1""")
def leading_sample(spark, d):
    lead = P.first_values(view(spark, d, TEXTS), V.SAMPLE_TYPE_ROWS)
    return lead.groupBy(F.col("column").alias("name")).agg(F.round(F.avg(F.col("value").rlike(V.DATE_LIKE).cast("int")), 4).alias("date_share"))


_DATE_TEXT = ["day_first", "iso", "vague", "money"]
_EVIDENCE = r"""SELECT '{c}' AS "column", count(*) AS filled, count(s) AS matched, bool_and(p1 >= 1000) AS all_iso, coalesce(bool_or(p1 > 12 AND p2 <= 12), false) AS day_first,
coalesce(bool_or(p2 > 12 AND p1 <= 12), false) AS day_second, arg_min(s, r) FILTER (s IS NOT NULL) AS sep FROM (
SELECT r, s, TRY_CAST(CASE WHEN s IS NOT NULL THEN string_split(t, s)[1] END AS INTEGER) AS p1, TRY_CAST(CASE WHEN s IS NOT NULL THEN string_split(t, s)[2] END AS INTEGER) AS p2 FROM (
SELECT _row_id AS r, trim({c}) AS t, CASE WHEN regexp_matches(trim({c}), '^\d{1,4}/\d{1,4}/\d{1,4}$') THEN '/' WHEN regexp_matches(trim({c}), '^\d{1,4}\.\d{1,4}\.\d{1,4}$') THEN '.'
WHEN regexp_matches(trim({c}), '^\d{1,4}-\d{1,4}-\d{1,4}$') THEN '-' END AS s FROM v WHERE {c} IS NOT NULL))"""


@query(f"WITH v AS ({TEXTS})\n" + each(_DATE_TEXT, _EVIDENCE))
def date_evidence(spark, d):
    return D.date_evidence(P.value_counts(view(spark, d, TEXTS), _DATE_TEXT)).select(
        "column", "filled", "matched", "all_iso", "day_first", "day_second", "sep"
    )


@query(f"""WITH v AS ({TEXTS}), e AS (
{each(["day_first", "iso", "vague"], _EVIDENCE)})
SELECT "column", CASE WHEN all_iso THEN concat('YYYY', sep, 'MM', sep, 'DD') WHEN day_first AND NOT day_second THEN concat('DD', sep, 'MM', sep, 'YYYY')
WHEN "column" = 'vague' THEN 'DD/MM/YYYY' ELSE 'ambiguous' END AS detected_format, CASE WHEN "column" = 'vague' THEN 0.75 ELSE 1.0 END AS confidence,
false AS needs_confirmation FROM e WHERE matched / filled >= 0.6""")
def resolve_dates(spark, d):
    # the vague column comes last and borrows the format of the first resolved one
    return D.resolve_dates(view(spark, d, TEXTS)).select("column", "detected_format", F.col("confidence").cast("double").alias("confidence"), "needs_confirmation")


@query(f"""WITH v AS ({TEXTS}) SELECT 'vague' AS "column", CASE WHEN count(vague) > 0 THEN 'ambiguous' END AS detected_format, 0.5 AS confidence, true AS needs_confirmation FROM v""")
def ambiguous_dates(spark, d):
    only = view(spark, d, TEXTS).select("_row_id", "vague", "priority")
    return D.resolve_dates(only).select("column", "detected_format", F.col("confidence").cast("double").alias("confidence"), "needs_confirmation")


# Dates whose order only the nation of the customer can settle.
LOCAL = """SELECT o.o_orderkey AS _row_id, lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o.o_orderdate) AS STRING) AS placed,
CASE WHEN o.o_orderkey % 2 = 0 THEN 'Germany' ELSE 'elsewhere' END AS country FROM orders o WHERE day(o.o_orderdate) <= 12"""


@query(f"""WITH v AS ({LOCAL}), first_ten AS (SELECT lower(country) AS c, _row_id FROM v ORDER BY _row_id LIMIT 10)
SELECT 'placed' AS "column", CASE WHEN (SELECT count(*) FROM first_ten WHERE c = 'germany') > 0 THEN 'DD.MM.YYYY' ELSE 'ambiguous' END AS detected_format,
CASE WHEN (SELECT count(*) FROM first_ten WHERE c = 'germany') > 0 THEN 0.7 ELSE 0.5 END AS confidence""")
def locale_dates(spark, d):
    return D.resolve_dates(view(spark, d, LOCAL)).select("column", "detected_format", F.col("confidence").cast("double").alias("confidence"))


@query(f"SELECT name, {first_match([(k, p) for k, p in V.PII_HEADER_RULES], 'trim(name)')} AS pii_type FROM ({WORDS})")
def pii_headers(spark, d):
    return words(spark, d).select("name", pii_by_header(F.col("name")).alias("pii_type"))


_LABEL = first_match(V.LABEL_RULES, "trim(name)")


@query(f"SELECT name, {_LABEL} AS label FROM ({WORDS})")
def semantic_headers(spark, d):
    return words(spark, d).select("name", label_by_header(F.col("name")).alias("label"))


def _share(c, p):
    return f"count(*) FILTER (regexp_matches(trim({c}), '{p}')) / count({c})"


@query(f"WITH v AS ({PEOPLE}), f AS (\n" + each(PEOPLE_COLUMNS, f"""SELECT '{{c}}' AS name, {_share('{c}', V.EMAIL_VALUE.replace('{2,}', '{{2,}}'))} AS e, {_share('{c}', V.PHONE_VALUE)} AS p,
{_share('{c}', V.CARD_VALUE)} AS k, {_share('{c}', V.SSN_VALUE + '|' + V.NATIONAL_12_VALUE)} AS s FROM v""".replace("{{", "{").replace("}}", "}")) + """)
SELECT name, CASE WHEN e >= 0.5 THEN 'email' WHEN p >= 0.5 THEN 'phone' WHEN k >= 0.5 THEN 'credit_card' WHEN s >= 0.5 THEN 'ssn_national_id' ELSE 'none' END AS pii_type FROM f""")
def pii_values(spark, d):
    return P.profile_columns(view(spark, d, PEOPLE)).select("name", "pii_type")


@query(f"WITH v AS ({PEOPLE}), f AS (\n" + each(PEOPLE_COLUMNS, f"""SELECT '{{c}}' AS name, {_share('{c}', V.EMAIL_VALUE.replace('{2,}', '{{2,}}'))} AS e, {_share('{c}', V.PHONE_VALUE)} AS p,
{_share('{c}', '[$€£₹¥]')} AS m, greatest({_share('{c}', V.EMAIL_VALUE)}, {_share('{c}', V.PHONE_VALUE)}, {_share('{c}', V.CARD_VALUE)}, {_share('{c}', V.SSN_VALUE)}) >= 0.5 AS pii FROM v""".replace("{{", "{").replace("}}", "}")) + """)
SELECT name, CASE WHEN e >= 0.7 THEN 'email' WHEN p >= 0.7 THEN 'phone' WHEN m >= 0.6 THEN 'currency_amount' ELSE 'unknown' END AS semantic_label,
CASE WHEN e >= 0.7 OR p >= 0.7 THEN 0.85 WHEN m >= 0.6 THEN 0.8 ELSE 0.4 END AS confidence,
CASE WHEN e >= 0.7 OR p >= 0.7 OR m >= 0.6 THEN 'pattern' WHEN pii THEN 'pii_blocked' ELSE 'rule' END AS method_used FROM f""")
def semantic_values(spark, d):
    return P.profile_columns(view(spark, d, PEOPLE)).select("name", "semantic_label", F.col("confidence").cast("double").alias("confidence"), "method_used")


# Whole numbers that look like ages, by name or by mean.
AGES = "SELECT p_partkey AS _row_id, p_size AS page_len, p_size + 20 AS years, p_size * 10 AS big, p_size AS stage FROM part"


@query(f"WITH v AS ({AGES})\n" + each(["page_len", "years", "big", "stage"], """SELECT '{c}' AS name, CASE WHEN min({c}) >= 0 AND max({c}) <= 120 AND ('{c}' LIKE '%age%' OR (avg({c}) > 10 AND avg({c}) < 70)) THEN 'age' ELSE 'unknown' END AS semantic_label,
CASE WHEN min({c}) >= 0 AND max({c}) <= 120 AND '{c}' LIKE '%age%' THEN 0.9 WHEN min({c}) >= 0 AND max({c}) <= 120 AND avg({c}) > 10 AND avg({c}) < 70 THEN 0.75 ELSE 0.4 END AS confidence FROM v"""))
def age_labels(spark, d):
    return P.profile_columns(view(spark, d, AGES)).select("name", "semantic_label", F.col("confidence").cast("double").alias("confidence"))


@query(f"""WITH v AS ({GAPPY})
{each(_GAP_COLUMNS, "SELECT '{c}' AS name, (count(DISTINCT {c}) BETWEEN 2 AND 10 AND (count(*) - count({c})) / count(*) < 0.2) AS is_target_candidate FROM v")}""")
def target_flags(spark, d):
    return P.profile_columns(view(spark, d, GAPPY)).select("name", "is_target_candidate")


def _votes(domain):
    kw = V.DOMAIN_KEYWORDS[domain]
    inside = " OR ".join(f"contains(name, '{w}')" for w in kw)
    return f"SELECT '{domain}' AS domain, sum(CASE WHEN label IN ({lit_list(kw)}) THEN 2 WHEN {inside} THEN 1 ELSE 0 END) AS score FROM w"


@query(f"WITH w AS (SELECT name, coalesce({_LABEL}, 'unknown') AS label FROM ({WORDS}))\n" + "\nUNION ALL\n".join(
    f"SELECT domain, CAST(score AS BIGINT) AS score FROM ({_votes(x)})" for x in V.DOMAIN_KEYWORDS))
def domain_vote(spark, d):
    headers = words(spark, d).withColumn("semantic_label", F.coalesce(label_by_header(F.col("name")), F.lit("unknown")))
    return P.domain_votes(headers)


@query(f"""WITH w AS (SELECT name, coalesce({_LABEL}, 'unknown') AS label FROM ({WORDS})), s AS (
{" UNION ALL ".join(f"SELECT domain, CAST(score AS BIGINT) AS score, {3 - i} AS o FROM ({_votes(x)})" for i, x in enumerate(V.DOMAIN_KEYWORDS))})
SELECT CASE WHEN max(score) >= 2 THEN arg_max(domain, score * 10 + o) ELSE 'generic' END AS domain,
CASE WHEN max(score) >= 2 THEN least(0.95, greatest(0.7, round(max(score) / sum(score), 2))) ELSE 0.5 END AS confidence FROM s""")
def classify_domain(spark, d):
    headers = words(spark, d).withColumn("semantic_label", F.coalesce(label_by_header(F.col("name")), F.lit("unknown")))
    return P.classify_domain(headers).select("domain", F.col("confidence").cast("double").alias("confidence"))


_N = len(_GAP_COLUMNS)


@query(f"""WITH v AS ({GAPPY}), p AS ({each(_GAP_COLUMNS, "SELECT '{c}' AS name, round((count(*) - count({c})) / count(*), 4) AS null_pct FROM v")}),
low AS (SELECT count(*) AS n FROM p WHERE {_LABEL} IS NULL)
SELECT CAST(round(100 - avg(null_pct) * 30 - 15.0 * any_value(n) / {_N}) AS INTEGER) AS score, round(avg(null_pct), 4) AS avg_null_pct, 0.0 AS duplicate_row_pct,
CAST(0 AS BIGINT) AS ambiguous_dates, any_value(n) AS low_confidence_columns FROM p, low""")
def quality_score(spark, d):
    df = view(spark, d, GAPPY)
    return P.quality_score(P.profile_columns(df), D.resolve_dates(df), P.duplicate_rate(df)).withColumn("duplicate_row_pct", F.col("duplicate_row_pct").cast("double"))


@query(f"""WITH v AS ({TEXTS}), n AS (SELECT round((count(*) - count(vague)) / count(*) * 100, 1) AS p FROM v)
SELECT 1 AS kind_no, 4 AS ordinal, concat(CAST(p AS VARCHAR), '% null values in column ''vague''') AS issue FROM n
UNION ALL SELECT 4, i, concat('Low-confidence semantic label in column ''', c, ''' (confidence: 0.4)')
FROM (SELECT i, name AS c FROM (VALUES (0, 'money'), (1, 'flag'), (2, 'day_first'), (3, 'iso'), (4, 'vague'), (5, 'priority'), (6, 'code_text'), (7, 'mostly_number')) t(i, name)
WHERE {_LABEL} IS NULL AND name <> 'money')""")
def quality_issues(spark, d):
    df = view(spark, d, TEXTS)
    return P.quality_issues(P.profile_columns(df), D.resolve_dates(df), P.duplicate_rate(df))


@query("""SELECT 'customer_id' AS name, 'int' AS dtype_inferred, 'identifier' AS semantic_label, false AS is_pii, 0.0 AS null_percent, count(DISTINCT c_custkey) AS unique_count FROM customer
UNION ALL SELECT 'email', 'string', 'email', true, 0.0, count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'full_name', 'string', 'person_name', true, 0.0, count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'balance', 'float', 'currency_amount', false, 0.0, count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'segment', 'category', 'unknown', false, 0.0, count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'nation_no', 'int', 'age', false, 0.0, count(DISTINCT c_nationkey) FROM customer""")
def column_inventory(spark, d):
    inv = P.column_inventory(P.profile_columns(view(spark, d, CLIENTS)))
    return inv.select("name", "dtype_inferred", "semantic_label", "is_pii", "null_percent", "unique_count")
