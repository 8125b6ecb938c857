"""Queries: numbers in texts, grounding, insights, masking, scorecards, run tables."""

from pyspark.sql import functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import kept_out_of_evidence, label_by_header, mask_text, numbers_in, pii_by_header, redact_secrets
from tabwise.operators import claims as G, insights as I, profile as P, runs as R, scorecards as X, sensitive as H, stats as S
from tabwise.plans.catalog_ask import WORDS, words
from tabwise.plans.catalog_profile import _LABEL
from tabwise.plans.registry import first_match, lit_list, query, table, view
from tabwise.plans.views import CLIENTS, PEOPLE
from tabwise.session import local_table, once

# RE2 knows only ASCII word boundaries; other letters become 'x' before numbers are read.
def _nums(t):
    plain = f"regexp_replace({t}, '(?:/|\\b[oO][uU][tT] [oO][fF]\\s+)\\s*100\\b', '', 'g')".replace("[oO][uU][tT] [oO][fF]", "out of")
    return f"regexp_extract_all(regexp_replace({plain}, '[^\\x00-\\x7F]', 'x', 'g'), '[-+]?\\b\\d+(?:,\\d{{3}})*(?:\\.\\d+)?%?\\b')".replace("{{3}}", "{3}")


@query(f"""SELECT conv_id, turn, len(n) AS found, round(coalesce(list_sum(list_transform(n, lambda x: CAST(regexp_replace(x, '[,%]', '', 'g') AS DOUBLE))), 0), 4) AS total
FROM (SELECT conv_id, turn, {_nums("concat(text, ' Rated ', turn, '/100, then 7 out of 100 and 12.')")} AS n FROM conversations)""")
def extract_numbers(spark, d):
    t = table(spark, d, "conversations")
    n = numbers_in(F.concat("text", F.lit(" Rated "), F.col("turn").cast("string"), F.lit("/100, then 7 out of 100 and 12.")))
    return t.select("conv_id", "turn", F.size(n).cast("bigint").alias("found"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# Claims about each line item, one dataset per return flag; facts are the flag's statistics.
CLAIMS = """SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_returnflag AS dataset_id, CASE l_orderkey % 6
WHEN 0 THEN concat('The average quantity is about ', CAST(l_quantity AS STRING), ' units.')
WHEN 1 THEN concat('Discounts reach ', CAST(CAST(l_discount * 1000 AS INT) AS STRING), '% in this group of 3 kinds.')
WHEN 2 THEN concat('Taxes of ', CAST(l_tax AS STRING), ' were seen, score 95/100.')
WHEN 3 THEN 'Quantities vary a lot.'
WHEN 4 THEN concat('At most 50 units, at least ', CAST(l_linenumber AS STRING), ' units.')
ELSE '' END AS text, 'quality' AS category, CAST(l_discount * 12 AS STRING) AS confidence,
CASE WHEN l_linenumber = 6 THEN '' ELSE 'table' END AS evidence, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'look' END AS recommendation FROM lineitem"""
FACTS = """SELECT l_returnflag AS dataset_id, avg(l_quantity) AS value FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, max(l_quantity) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, min(l_quantity) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, avg(l_discount) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, max(l_discount) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, max(l_tax) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, CAST(3 AS DOUBLE) FROM lineitem GROUP BY l_returnflag"""

_GROUNDED = f"""WITH c AS (SELECT row_number() OVER () AS id, * FROM ({CLAIMS})), f AS ({FACTS}), n AS (SELECT id, dataset_id, CAST(regexp_replace(unnest({_nums('text')}), '[,%]', '', 'g') AS DOUBLE) AS x FROM c),
d AS (SELECT DISTINCT dataset_id, x FROM n), j AS (SELECT d.dataset_id, d.x, EXISTS (SELECT 1 FROM f WHERE f.dataset_id = d.dataset_id AND CASE WHEN f.value % 1 = 0 THEN abs(d.x - f.value) <= 0.01
ELSE abs(d.x - f.value) <= 0.02 OR abs(d.x - f.value) / abs(f.value) <= 0.05 OR (f.value > 0 AND f.value <= 1 AND (abs(d.x - f.value * 100) <= 0.5 OR abs(d.x - f.value * 100) / (f.value * 100) <= 0.05)) END) AS ok FROM d),
g AS (SELECT n.id, count(*) AS numbers, count(*) FILTER (NOT j.ok) AS bad FROM n JOIN j ON n.dataset_id = j.dataset_id AND n.x = j.x GROUP BY 1),
r AS (SELECT c.*, coalesce(g.numbers, 0) AS numbers, coalesce(g.bad, 0) AS bad FROM c LEFT JOIN g ON c.id = g.id)"""


@query(f"{_GROUNDED} SELECT claim_id, numbers, bad, trim(text) <> '' AND numbers > 0 AND bad = 0 AS is_grounded FROM r")
def ground_numbers(spark, d):
    out = G.ground_claims(view(spark, d, CLAIMS), view(spark, d, FACTS))
    return out.select("claim_id", F.size("numbers").cast("bigint").alias("numbers"), F.size("ungrounded").cast("bigint").alias("bad"), "is_grounded")


@query(f"{_GROUNDED} SELECT claim_id, bad, trim(text) <> '' AND numbers > 0 AND bad = 0 AS is_grounded FROM r")
def ground_numbers_sorted(spark, d):
    # few_facts=0 takes the sorted merge that suits any number of facts
    out = G.ground_claims(view(spark, d, CLAIMS), view(spark, d, FACTS), few_facts=0)
    return out.select("claim_id", F.size("ungrounded").cast("bigint").alias("bad"), "is_grounded")


_CONTRACT = f"""CASE WHEN coalesce(trim(category), '') = '' THEN 'Missing or empty ''category'' field' WHEN lower(trim(category)) NOT IN ({lit_list(V.CLAIM_CATEGORIES)}) THEN 'Invalid ''category'''
WHEN coalesce(trim(text), '') = '' THEN 'Missing or empty ''text'' field' WHEN TRY_CAST(confidence AS DOUBLE) IS NULL THEN 'Invalid ''confidence'' value'
WHEN TRY_CAST(confidence AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'Out-of-range ''confidence'' value' WHEN coalesce(trim(evidence), '') = '' THEN 'Missing or empty ''evidence'' field'
WHEN coalesce(trim(recommendation), '') = '' THEN 'Missing or empty ''recommendation'' field' ELSE '' END"""


@query(f"SELECT claim_id, {_CONTRACT} AS contract_reason FROM ({CLAIMS})")
def check_contract(spark, d):
    return G.check_contract(view(spark, d, CLAIMS)).select("claim_id", "contract_reason")


@query(f"""{_GROUNDED}, k AS (SELECT *, {_CONTRACT} AS contract_reason, trim(text) <> '' AND numbers > 0 AND bad = 0 AS ok FROM r) SELECT claim_id, contract_reason = '' AND ok AS accepted, contract_reason,
CASE WHEN contract_reason <> '' THEN contract_reason WHEN ok THEN '' WHEN numbers = 0 THEN 'Insight contains zero numbers (unquantifiable claim)' ELSE 'Ungrounded numerical claim(s) detected' END AS rejection FROM k""")
def screen_claims(spark, d):
    out = G.screen_claims(view(spark, d, CLAIMS), view(spark, d, FACTS))
    rejection = F.coalesce(F.regexp_replace("rejection", r": \[.*\]$", ""), F.lit(""))  # numbers are spelled differently elsewhere
    return out.select("claim_id", "accepted", "contract_reason", rejection.alias("rejection"))


JSONS = """SELECT c_custkey, concat('Here you go: [{"category": "quality", "text": "Balance ', CAST(c_acctbal AS STRING), '", "confidence": 0.5, "evidence": "e", "recommendation": "r"}, {"category": "odd", "text": "',
c_mktsegment, '", "confidence": "0.9"}] Bye') AS raw FROM customer"""


@query("""SELECT c_custkey, CAST(0 AS INTEGER) AS place, 'quality' AS category, concat('Balance ', CAST(c_acctbal AS VARCHAR)) AS text, '0.5' AS confidence, 'e' AS evidence, 'r' AS recommendation FROM customer
UNION ALL SELECT c_custkey, 1, 'odd', c_mktsegment, NULL, NULL, NULL FROM customer""")
def parse_claims(spark, d):
    return G.parse_claims(view(spark, d, JSONS), "raw", ["c_custkey"]).select("c_custkey", "place", "category", "text", "confidence", "evidence", "recommendation")


_EVID = V.EVIDENCE_HEADER.replace("'", "''")


@query(f"""SELECT name, (({first_match(V.PII_HEADER_RULES, 'name')}) IS NOT NULL OR coalesce({_LABEL}, 'unknown') IN ({lit_list(V.EVIDENCE_LABELS)}) OR regexp_matches(name, '{_EVID}')) AS excluded FROM ({WORDS})""")
def evidence_exclusions(spark, d):
    kind = F.coalesce(pii_by_header(F.col("name")), F.lit("none"))
    label = F.coalesce(label_by_header(F.col("name")), F.lit("unknown"))
    return words(spark, d).select("name", kept_out_of_evidence(F.col("name"), kind != "none", label, kind).alias("excluded"))


# --- facts and insights of one table ------------------------------------------------

def client_facts(spark, d) -> I.Facts:
    """Fact tables of the clients view, without a model."""
    from tabwise.operators import dates as D
    from tabwise.plans.analyse import MODEL_FACTS
    from tabwise.session import settle

    df = view(spark, d, CLIENTS)
    profile = settle(P.profile_columns(df))
    dates = settle(D.resolve_dates(df))
    dup = settle(P.duplicate_rate(df))
    rows = profile.collect()
    numeric, categorical = (settle(x) for x in S.dataset_summary(df, rows))
    names = S.eligible_numeric(df, rows)
    empty = local_table(spark, [], "step_no int, column string, method string, replacement_value string, details map<string,double>")
    return I.Facts(
        "clients", profile, local_table(spark, [(rows[0]["n_rows"], len(rows))], "n_rows long, n_columns int"),
        settle(P.quality_score(profile, dates, dup)), settle(P.quality_issues(profile, dates, dup)), settle(P.classify_domain(profile)), dates,
        numeric, categorical, settle(S.pearson_pairs(df, names)), settle(S.spearman_pairs(df, names)),
        local_table(spark, [("skipped", None, None, None, None, None, None, None, "not requested")], MODEL_FACTS),
        local_table(spark, [], "feature string, importance double"), empty,
    )


_CLIENT = """WITH s AS (SELECT count(*) AS n, round(avg(c_acctbal), 4) AS m, round(quantile_cont(c_acctbal, 0.5), 4) AS md, round(min(c_acctbal), 4) AS lo, round(max(c_acctbal), 4) AS hi,
round(stddev_samp(c_acctbal), 4) AS sd, round(avg(c_nationkey), 4) AS nm, round(quantile_cont(c_nationkey, 0.5), 4) AS nmd, min(c_nationkey) AS nlo, max(c_nationkey) AS nhi, corr(c_acctbal, c_nationkey) AS r FROM customer),
t AS (SELECT c_mktsegment AS v, count(*) AS k, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS u FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query(_CLIENT + """
SELECT 'distribution' AS category, printf('Column ''balance'' averages %.2f (median: %.2f) spanning a range from %.2f to %.2f.', m, md, lo, hi) AS text FROM s
UNION ALL SELECT 'distribution', printf('Column ''nation_no'' averages %.2f (median: %.2f) spanning a range from %.2f to %.2f.', nm, nmd, CAST(nlo AS DOUBLE), CAST(nhi AS DOUBLE)) FROM s
UNION ALL SELECT 'distribution', printf('Column ''segment'' has %d unique categories, led by ''%s'' with %d occurrences (%.1f%% of total).', u, v, k, k * 100.0 / n) FROM s, t
UNION ALL SELECT 'quality', printf('Analyzed dataset of %d rows and 6 columns with an overall data quality score of 98/100.', n) FROM s
UNION ALL SELECT 'correlation', printf('Detected a mild %s linear correlation of %.2f between ''balance'' and ''nation_no''.', CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, r) FROM s WHERE abs(r) >= 0.2""")
def rule_insights(spark, d):
    return I.rule_insights(client_facts(spark, d)).select("category", "text")


_STATS = """count({c}) AS count, count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) * 100 AS null_pct, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25,
quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c}) AS max, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis"""


def _numbers_of(name, column):
    row = f"SELECT {_STATS.replace('{c}', column)} FROM customer"
    return " UNION ALL ".join(f"SELECT 'numeric.{name}.{k}', round({k}, 4) FROM ({row})" for k in S.NUMERIC_SUMMARY[1:])


@query(_CLIENT + f""", g AS (SELECT c_mktsegment AS v, count(*) AS k, count(*) * 100.0 / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
a AS (SELECT c_acctbal AS x, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rx, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS ry FROM customer),
f(path, value) AS (SELECT 'shape.n_rows', CAST(n AS DOUBLE) FROM s UNION ALL SELECT 'shape.n_columns', 6.0 FROM s UNION ALL SELECT 'quality.score', 98.0 FROM s
UNION ALL {_numbers_of("balance", "c_acctbal")} UNION ALL {_numbers_of("nation_no", "c_nationkey")}
UNION ALL SELECT 'categorical.segment.unique_count', u FROM t UNION ALL SELECT 'categorical.segment.n', k FROM g UNION ALL SELECT 'categorical.segment.pct1', round(p, 1) FROM g
UNION ALL SELECT 'categorical.segment.pct2', round(p, 2) FROM g UNION ALL SELECT 'pearson.balance.nation_no', round(r, 4) FROM s UNION ALL SELECT 'spearman.balance.nation_no', round(corr(rx, ry), 4) FROM a)
SELECT path, CAST(value AS DOUBLE) AS value, CASE WHEN path LIKE '%.pct_' THEN false ELSE value % 1 = 0 END AS is_int FROM f""")
def fact_base(spark, d):
    return I.fact_base(client_facts(spark, d)).select("path", "value", "is_int")


@query()
def evidence_summary(spark, d):
    return I.evidence_summary(client_facts(spark, d))


@query()
def chat_context(spark, d):
    f = client_facts(spark, d)
    return I.chat_context(f, I.rule_insights(f))


@query(_CLIENT + """, i AS (SELECT printf('Column ''balance'' averages %.2f (median: %.2f) spanning a range from %.2f to %.2f.', m, md, lo, hi) AS a,
printf('Column ''nation_no'' averages %.2f (median: %.2f) spanning a range from %.2f to %.2f.', nm, nmd, CAST(nlo AS DOUBLE), CAST(nhi AS DOUBLE)) AS b,
printf('Column ''segment'' has %d unique categories, led by ''%s'' with %d occurrences (%.1f%% of total).', u, v, k, k * 100.0 / n) AS c,
printf('Detected a mild %s linear correlation of %.2f between ''balance'' and ''nation_no''.', CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, r) AS e, abs(r) >= 0.2 AS told FROM s, t)
SELECT 'shape' AS topic, printf('The dataset contains %d rows and 6 columns.', n) AS answer FROM s
UNION ALL SELECT 'targets', 'Potential target candidates identified in the dataset: segment.' FROM t WHERE u BETWEEN 2 AND 10
UNION ALL SELECT 'model', 'Machine learning status: skipped.' FROM s
UNION ALL SELECT 'quality', 'The dataset has an overall data quality score of 98/100. Key issues identified: Low-confidence semantic label in column ''segment'' (confidence: 0.4)' FROM s
UNION ALL SELECT 'domain', 'The detected domain for this dataset is Generic (confidence: 50.0%).' FROM s
UNION ALL SELECT 'insights', concat('Key analytical insights:', CASE WHEN told THEN concat(chr(10), '- ', e) ELSE '' END, chr(10), '- ', a, chr(10), '- ', b, CASE WHEN told THEN '' ELSE concat(chr(10), '- ', c) END) FROM i""")
def fact_answers(spark, d):
    f = client_facts(spark, d)
    return I.fact_answers(f, I.rule_insights(f))


@query(_CLIENT + """, a AS (SELECT n_nationkey AS place, concat('Nation ', n_name, ' has number ', n_nationkey, '.') AS text FROM nation WHERE n_nationkey < 2),
r AS (SELECT 1 AS k, printf('Column ''balance'' averages %.2f (median: %.2f) spanning a range from %.2f to %.2f.', m, md, lo, hi) AS text FROM s WHERE abs(r) < 0.2
UNION ALL SELECT 2, printf('Column ''nation_no'' averages %.2f (median: %.2f) spanning a range from %.2f to %.2f.', nm, nmd, CAST(nlo AS DOUBLE), CAST(nhi AS DOUBLE)) FROM s WHERE abs(r) < 0.2)
SELECT printf('ins_%03d', place + 1) AS id, 'quality' AS category, text FROM a UNION ALL SELECT printf('ins_%03d', k + 2), 'distribution', text FROM r""")
def merge_insights(spark, d):
    """Two accepted claims, and rule insights up to four, since the claims are fewer than three."""
    accepted = view(spark, d, "SELECT n_nationkey AS place, ' Quality ' AS category, concat('Nation ', n_name, ' has number ', CAST(n_nationkey AS STRING), '.') AS text, 0.5 AS confidence, 'nation' AS evidence, 'look' AS recommendation FROM nation WHERE n_nationkey < 2")
    return I.merge_insights(accepted, I.rule_insights(client_facts(spark, d)), 3, 4).select("id", "category", "text")


@query()
def report_payload(spark, d):
    f = client_facts(spark, d)
    return I.report_payload(f, I.rule_insights(f))


@query("""SELECT CAST(1 AS INTEGER) AS place, 'Data Quality Issue: Low-confidence semantic label in column ''segment'' (confidence: 0.4)' AS limitation FROM customer HAVING count(*) > 0""")
def limitations(spark, d):
    f = client_facts(spark, d)
    return I.limitations(f, I.rule_insights(f))


# --- masking --------------------------------------------------------------------------

_B0, _B1 = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
_EMAIL = _B0 + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + _B1
_PHONE = _B0 + r"(?:\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}" + _B1
_CARD = _B0 + r"(?:\d{4}[-\s]?){3}\d{4}" + _B1
_SSN = _B0 + r"\d{3}-\d{2}-\d{4}" + _B1
_MASK = f"""CASE WHEN {{c}} IS NULL THEN '<NULL>' WHEN regexp_matches({{c}}, '{_EMAIL}') THEN '[REDACTED_EMAIL]' WHEN regexp_matches({{c}}, '{_PHONE}') THEN '[REDACTED_PHONE]'
WHEN regexp_matches({{c}}, '{_CARD}') THEN '[REDACTED_CREDIT_CARD]' WHEN regexp_matches({{c}}, '{_SSN}') THEN '[REDACTED_SSN]' ELSE trim({{c}}) END"""


def _mask(c):
    return _MASK.replace("{c}", c)


@query(f"SELECT doc_id, {_mask('text')} AS masked FROM documents")
def mask_documents(spark, d):
    return H.mask_texts(table(spark, d, "documents"), "text").select("doc_id", "masked")


@query("SELECT c_custkey AS customer_id, '[REDACTED_EMAIL]' AS email, '[REDACTED_NAME]' AS full_name, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation_no FROM customer")
def mask_table(spark, d):
    return H.mask_columns(view(spark, d, CLIENTS), {"email": "email", "full_name": "name"})


@query("SELECT c_custkey AS customer_id, '[REDACTED_EMAIL]' AS email, '[REDACTED_NAME]' AS full_name, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation_no FROM customer ORDER BY c_custkey LIMIT 5")
def masked_preview(spark, d):
    return H.masked_preview(view(spark, d, CLIENTS), {"email": "email", "full_name": "name"}, 5, "customer_id")


@query(f"SELECT _row_id, {_mask('col_e')} AS sample FROM ({PEOPLE}) WHERE col_e IS NOT NULL AND trim(col_e) <> '' ORDER BY _row_id LIMIT 10")
def masked_samples(spark, d):
    return H.masked_samples(view(spark, d, PEOPLE), "col_e", 10)


@query("""WITH v AS (SELECT DISTINCT trim(w) AS v FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS w FROM benchmark) WHERE length(w) >= 3)
SELECT doc_id, (SELECT count(*) FROM v WHERE contains(text, v)) AS leaked FROM documents""")
def leak_scan(spark, d):
    values = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("v")).where("length(v) >= 3")
    return H.leak_scan(table(spark, d, "documents"), "doc_id", "text", values, "v", few=0)


@query("""WITH v AS (SELECT unnest(['secret', 'password', 'license', 'token', 'ab']) AS v), s AS (SELECT (SELECT count(*) FROM v WHERE length(v) >= 3 AND contains(text, v)) AS leaked FROM documents)
SELECT count(*) AS texts, count(*) FILTER (leaked > 0) AS texts_with_leaks, CAST(sum(leaked) AS BIGINT) AS leaked_values FROM s""")
def leak_summary(spark, d):
    values = local_table(spark, [(x,) for x in ("secret", "password", "license", "token", "ab")], "v string")
    return H.leak_summary(H.leak_scan(table(spark, d, "documents"), "doc_id", "text", values, "v"))


_PAIR = V.SECRET_PAIR.replace("'", "''")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_PAIR}', '\\1: [REDACTED]', 'g'), '{V.SECRET_KEY}', '[REDACTED_API_KEY]', 'g') AS line FROM documents")
def redact_log_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", redact_secrets(F.col("text")).alias("line"))


# --- scorecards -------------------------------------------------------------------------

# Words per document language stand in for columns of several datasets.
LANG_WORDS = "SELECT DISTINCT lang AS dataset, w AS name FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS w FROM documents) WHERE w <> ''"


def lang_words(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("dataset"), F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("name")).where("name <> ''").distinct()


def _predicted(spark, d):
    label = F.coalesce(label_by_header(F.col("name")), F.lit("unknown"))
    judged = once(lang_words(spark, d), F.struct(label.alias("semantic_label"), pii_by_header(F.col("name")).isNotNull().alias("is_pii")))
    return judged.withColumn("confidence", F.when(F.col("semantic_label") == "unknown", 0.4).otherwise(0.9))


def _labels():
    return F.when(F.length("name") % 3 == 0, F.array(F.lit("identifier"))).when(F.length("name") % 3 == 1, F.array(F.lit("unknown"), F.lit("email"))).otherwise(F.array(F.lit("geo"), F.lit("score")))


_HIT = """CASE length(name) % 3 WHEN 0 THEN contains('identifier', label) OR contains(label, 'identifier') WHEN 1 THEN contains('unknown', label) OR contains(label, 'unknown') OR contains('email', label) OR contains(label, 'email')
ELSE contains('geo', label) OR contains(label, 'geo') OR contains('score', label) OR contains(label, 'score') END"""


@query(f"""WITH p AS (SELECT dataset, name, coalesce({_LABEL}, 'unknown') AS label FROM ({LANG_WORDS})), h AS (SELECT dataset, length(name) % 3 AS class, label, ({_HIT})::INT AS hit FROM p),
m AS (SELECT dataset, round(avg(a), 4) AS macro_accuracy FROM (SELECT dataset, class, avg(hit) AS a FROM h GROUP BY 1, 2) GROUP BY 1)
SELECT h.dataset, round(avg(hit), 4) AS accuracy, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total, count(*) FILTER (label = 'unknown') AS low_confidence_count, any_value(macro_accuracy) AS macro_accuracy FROM h JOIN m USING (dataset) GROUP BY 1""")
def semantic_scorecard(spark, d):
    expected = lang_words(spark, d).select("dataset", F.col("name").alias("column"), _labels().alias("labels"))
    return X.semantic_score(_predicted(spark, d), expected)


@query(f"""WITH p AS (SELECT dataset, name, ({first_match(V.PII_HEADER_RULES, 'name')}) IS NOT NULL AS got, length(name) = 4 AS want FROM ({LANG_WORDS})),
c AS (SELECT dataset, count(*) FILTER (got AND want) AS tp, count(*) FILTER (want AND NOT got) AS fn, count(*) FILTER (got AND NOT want) AS fp FROM p GROUP BY 1)
SELECT dataset, tp, fn, fp, round(coalesce(tp / nullif(tp + fn, 0), 1), 4) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 1), 4) AS precision FROM c""")
def pii_scorecard(spark, d):
    expected = lang_words(spark, d).select("dataset", F.col("name").alias("column"), (F.length("name") == 4).alias("is_pii"))
    return X.pii_score(_predicted(spark, d), expected)


@query("""SELECT source AS dataset, CASE WHEN max(lang) = 'en' THEN 1.0 ELSE 0.0 END AS accuracy FROM documents GROUP BY 1""")
def domain_scorecard(spark, d):
    per = table(spark, d, "documents").groupBy(F.col("source").alias("dataset")).agg(F.max("lang").alias("domain"))
    return X.domain_score(per, per.select("dataset", F.lit("EN").alias("domain"))).select("dataset", F.col("accuracy").cast("double").alias("accuracy"))


# Every order is one "date column" of its customer's dataset.
DATES = """SELECT CAST(o_custkey AS STRING) AS dataset, CAST(o_orderkey AS STRING) AS `column`, CASE WHEN o_orderkey % 4 = 0 THEN 'ambiguous' WHEN o_orderkey % 4 = 1 THEN 'DD/MM/YYYY' WHEN o_orderkey % 4 = 2 THEN 'YYYY.MM.DD' ELSE 'MM-DD-YYYY' END AS detected_format,
o_orderkey % 8 = 0 AS needs_confirmation FROM orders"""


@query("""WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset, o_orderkey % 4 AS k, o_orderkey % 8 = 0 AS conf, o_orderstatus = 'F' AS vague, 'DD-MM-YYYY' AS want FROM orders),
s AS (SELECT dataset, vague AND k = 0 AND conf AS flagged, vague AND NOT (k = 0 AND conf) AS silent, NOT vague AND k = 1 AS fits FROM p)
SELECT dataset, round(avg((flagged OR fits)::INT), 4) AS accuracy, count(*) FILTER (flagged) AS ambiguous_flagged, count(*) FILTER (silent) AS silent_guesses, count(*) AS evaluated FROM s GROUP BY 1""")
def date_scorecard(spark, d):
    expected = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset"), F.col("o_orderkey").cast("string").alias("column"), F.lit("DD-MM-YYYY").alias("format"), (F.col("o_orderstatus") == "F").alias("ambiguous")
    )
    return X.date_score(view(spark, d, DATES), expected)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS dataset, CAST(m AS INTEGER) AS met, round(m / 4.0, 4) AS accuracy, m = 4 AS passed FROM (
SELECT c_custkey, 2 + (c_nationkey % 2 = 0)::INT + (c_acctbal > 0)::INT AS m FROM customer)""")
def cleaning_scorecard(spark, d):
    c = table(spark, d, "customer")
    actual = c.select(F.col("c_custkey").cast("string").alias("dataset"), F.lit(10).alias("rows_before"), F.lit(9).alias("rows_after"), (F.col("c_nationkey") % 2).alias("duplicates_removed"), F.when(F.col("c_acctbal") > 0, 0).otherwise(1).alias("missing_after"))
    expected = c.select(F.col("c_custkey").cast("string").alias("dataset"), F.lit(10).alias("rows_before"), F.lit(9).alias("rows_after"), F.lit(0).alias("duplicates_removed"), F.lit(0).alias("missing_after"))
    return X.cleaning_score(actual, expected)


@query("""WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS dataset, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1)
SELECT dataset, (abs(a - 25.5) <= greatest(0.01 * 25.5, 0.05))::BIGINT + (abs(b - 0.05) <= 0.05)::BIGINT AS stats_verified, CAST(3 AS BIGINT) AS stats_total, true AS pii_excluded,
round(((abs(a - 25.5) <= greatest(0.01 * 25.5, 0.05))::INT + (abs(b - 0.05) <= 0.05)::INT + 2) / 5.0, 4) AS accuracy FROM s""")
def stat_scorecard(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("dataset")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"))
    stats = per.select("dataset", F.explode(F.array(
        F.struct(F.lit("l_quantity").alias("column"), F.lit("mean").alias("stat"), F.col("a").alias("value")), F.struct(F.lit("l_discount").alias("column"), F.lit("mean").alias("stat"), F.col("b").alias("value")),
    )).alias("e")).select("dataset", "e.*")
    expected = per.select("dataset", F.explode(F.array(
        F.struct(F.lit("l_quantity").alias("column"), F.lit("mean").alias("stat"), F.lit(25.5).alias("expected")), F.struct(F.lit("l_discount").alias("column"), F.lit("mean").alias("stat"), F.lit(0.05).alias("expected")),
        F.struct(F.lit("l_lost").alias("column"), F.lit("mean").alias("stat"), F.lit(1.0).alias("expected")),
    )).alias("e")).select("dataset", "e.*")
    seen = stats.select("dataset", "column")
    return X.statistics_score(stats, expected, seen, per.select("dataset", F.lit("c_name").alias("column")))


@query("""SELECT CAST(user_id AS VARCHAR) AS dataset, CASE WHEN k = 0 THEN (CASE WHEN ran THEN 0.0 ELSE 1.0 END) ELSE round((ran::INT + 1 + (k = 1)::INT + 1 + ran::INT) / 5.0, 4) END AS score,
CASE WHEN k = 0 AND NOT ran THEN 'SKIPPED_INSUFFICIENT_DATA' WHEN k = 0 THEN 'FAILED' WHEN ran THEN 'TRAINED' ELSE 'FAILED' END AS status FROM (SELECT user_id, user_id % 3 AS k, count(*) > 5 AS ran FROM events GROUP BY 1)""")
def model_scorecard(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg((F.count("*") > 5).alias("ran"))
    runs = per.select(F.col("user_id").cast("string").alias("dataset"), F.when(F.col("ran"), "trained").otherwise("skipped").alias("status"), F.lit("y").alias("target"), F.lit("classification").alias("task"), F.create_map(F.lit("f1"), F.lit(1.0)).alias("metrics"), F.col("ran").alias("saved"))
    expected = per.select(F.col("user_id").cast("string").alias("dataset"), (F.col("user_id") % 3 != 0).alias("applicable"), F.lit("y").alias("target"), F.when(F.col("user_id") % 3 == 1, "classification").otherwise("regression").alias("task"))
    return X.model_score(runs, expected).select("dataset", F.col("score").cast("double").alias("score"), "status")


@query(f"""WITH c AS (SELECT dataset_id AS dataset, text, evidence FROM ({CLAIMS})), f AS (SELECT DISTINCT dataset_id AS dataset, round(value, 2) AS v FROM ({FACTS})),
n AS (SELECT row_number() OVER () AS id, dataset, evidence, regexp_extract_all(regexp_replace(text, '/\\s*100\\b', '', 'g'), '\\b\\d+(?:\\.\\d+)?\\b') AS x FROM c),
e AS (SELECT id, dataset, round(CAST(unnest(x) AS DOUBLE), 2) AS x FROM n), u AS (SELECT DISTINCT dataset, x FROM e WHERE x NOT IN (1, 2, 3)),
b AS (SELECT dataset, x FROM u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dataset = u.dataset AND abs(u.x - f.v) <= 0.05 * greatest(abs(u.x), abs(f.v), 1.0))),
k AS (SELECT e.id, count(*) AS made FROM e JOIN b ON e.dataset = b.dataset AND e.x = b.x GROUP BY 1)
SELECT n.dataset, count(*) FILTER (coalesce(made, 0) = 0 AND evidence <> '') AS supported, count(*) FILTER (NOT (coalesce(made, 0) = 0 AND evidence <> '')) AS unsupported, CAST(coalesce(sum(made), 0) AS BIGINT) AS fabricated FROM n LEFT JOIN k ON n.id = k.id GROUP BY 1""")
def claim_scorecard(spark, d):
    claims = view(spark, d, CLAIMS).withColumnRenamed("dataset_id", "dataset")
    return X.claim_score(claims, view(spark, d, FACTS).withColumnRenamed("dataset_id", "dataset")).select("dataset", "supported", "unsupported", "fabricated")


@query("""SELECT user_id AS run_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase,
round(sum(value) FILTER (event_type = 'signup'), 4) AS signup, round(sum(value) FILTER (event_type = 'error'), 4) AS error, round(coalesce(sum(value), 0), 2) AS total FROM events GROUP BY 1""")
def stage_runtimes(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    out = X.stage_runtimes(m, ["click", "view", "purchase", "signup", "error"])
    return out.select("run_id", *[F.round(c, 4).alias(c) for c in ("click", "view", "purchase", "signup", "error")], F.round("total", 2).alias("total"))


@query("SELECT event_type AS evaluator, count(DISTINCT user_id) AS datasets, round(avg(value), 4) AS mean_score FROM events GROUP BY 1")
def suite_means(spark, d):
    return X.suite_means(table(spark, d, "events").select(F.col("event_type").alias("evaluator"), F.col("user_id").alias("dataset"), F.col("value").alias("score")))


_CALLS = "SELECT user_id AS run_id, event_id AS call_no, CAST(floor(abs(value)) AS BIGINT) AS tokens FROM events"


@query(f"""SELECT run_id, call_no, tokens, CAST(sum(tokens) OVER w AS BIGINT) AS cumulative_tokens, CAST(greatest(0, 200 - sum(tokens) OVER w) AS BIGINT) AS remaining_tokens, sum(tokens) OVER w > 200 AS past_budget
FROM ({_CALLS}) WINDOW w AS (PARTITION BY run_id ORDER BY call_no ROWS UNBOUNDED PRECEDING)""")
def usage_ledger(spark, d):
    return R.usage_ledger(view(spark, d, _CALLS), 200, chunk=1000).select("run_id", "call_no", "tokens", "cumulative_tokens", "remaining_tokens", "past_budget")


@query(f"SELECT run_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(greatest(0, 200 - sum(tokens)) AS BIGINT) AS remaining_tokens, sum(tokens) >= 200 AS is_exhausted FROM ({_CALLS}) GROUP BY 1")
def budget_totals(spark, d):
    return R.budget_totals(view(spark, d, _CALLS), 200)


_RUNS = "SELECT event_id AS run_id, ts AS created_at, event_type AS status, value AS seconds FROM events"


@query(f"SELECT run_id, created_at, status FROM ({_RUNS}) WHERE status = 'purchase' ORDER BY created_at DESC, run_id LIMIT 50")
def newest_runs(spark, d):
    return R.newest_runs(view(spark, d, _RUNS), 50, "purchase").select("run_id", "created_at", "status")


@query(f"SELECT status, count(*) AS runs, round(avg(seconds), 4) AS mean_seconds FROM ({_RUNS}) GROUP BY 1")
def status_summary(spark, d):
    return R.status_summary(view(spark, d, _RUNS))


@query("""SELECT 'columns' AS section, '''columns'' lacks field ''semantic_label''' AS issue FROM customer HAVING count(*) > 0 UNION ALL SELECT 'date_columns', '''date_columns'' is missing' FROM customer HAVING count(*) > 0
UNION ALL SELECT 'header', 'Missing ''schema_version''' FROM nation WHERE n_nationkey = 0""")
def metadata_issues(spark, d):
    clients = P.profile_columns(view(spark, d, CLIENTS)).drop("semantic_label")
    numeric = S.numeric_summary(table(spark, d, "customer"), ["c_acctbal"])
    log = local_table(spark, [], "step_no int, column string, method string, reason string")
    ids = table(spark, d, "nation").select(F.col("n_name").alias("dataset_id"), F.when(F.col("n_nationkey") != 0, "1.0").alias("schema_version"))
    return R.metadata_issues({"columns": clients, "numeric_stats": numeric, "cleaning_log": log}, ids)
