"""Queries op1_ to op13_, one per operator, over whole tables; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, decontaminate, licenses, mixture, packing, personal, quality, secrets, simhash, substrings, tokens, toxicity, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Vocabulary of the token count.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), tokens.read_vocabulary(VOCABULARY))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(table(spark, folder, "documents")).drop("cleaned")


SQL["op4_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, unnest(range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS i FROM d),
t AS (SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS t FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM t WHERE t IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) x(k) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, line, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS odd, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  right(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) AS last FROM l),
j AS (SELECT rid, line, n, n > 0 AS has, regexp_matches(line, '{quality.NAVIGATION}') OR odd > {quality.MOST_SYMBOLS} * length(line)
  OR length(line) <= {quality.BOILERPLATE_CHARS} AND regexp_matches(line, '{quality.BOILERPLATE}')
  OR NOT contains('{quality.END_MARKS.replace("'", "''")}', last) AND n BETWEEN 1 AND {quality.SHORT_LINE} AS lost FROM m),
v AS (SELECT rid, count(*) FILTER (has) - count(DISTINCT line) FILTER (has) AS dup, coalesce(sum(n) FILTER (lost), 0) AS lost FROM j GROUP BY rid),
r AS (SELECT d.doc_id, coalesce(counts.n, 0) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, v.lost::BIGINT AS n_lost_words
  FROM d JOIN v USING (rid) LEFT JOIN counts USING (rid) LEFT JOIN covered USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= {quality.MOST_LOST} * n_words AS kept FROM r
"""


@query
def op6_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"), keep_text=False).drop("kept_text")


SQL["op9_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT rid, doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
s AS (SELECT rid, doc_id, i, string_agg(w, ' ') OVER o AS win, count(*) OVER o AS n FROM w
  WINDOW o AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
g AS (SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY win) AS later FROM s WHERE n = 13),
c AS (SELECT DISTINCT rid, i + k AS i FROM g, range(13) x(k) WHERE later),
k AS (SELECT w.rid, count(*) AS n, count(c.i) AS gone, string_agg(w.w, ' ' ORDER BY w.i) FILTER (c.i IS NULL) AS kept FROM w LEFT JOIN c ON w.rid = c.rid AND w.i = c.i GROUP BY w.rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _joined(found, kinds=None):
    """Spans as text: kind:start:end, in their order."""
    chosen = F.filter(found, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(found)
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(found: str, kind: str):
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    base = secrets.KINDS[:3]
    return found.select("doc_id", *(_count("findings", k).alias(f"n_{k}") for k in base), F.sha2(_joined("findings", base), 256).alias("base_sha256"), _joined("findings").alias("spans"))


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find_personal(table(spark, folder, "documents"))
    base = personal.KINDS
    return found.select("doc_id", *(_count("spans", k).alias(f"n_{k}") for k in base), F.sha2(_joined("spans", base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixture.plan_mixture(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("shards").cast("long").alias("n_copies"), F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"))


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack_documents(table(spark, folder, "documents"), f.read())


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
low AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails FROM d JOIN low USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, i::INT AS step, filter_order[i] AS f, filter_order[1:i - 1] AS before FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, s.f, contains(fails, s.f) AS fail, length(translate(fails, before, '')) = length(fails) AS reached, fails = s.f AS alone, n, good, bad FROM c, s),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (reached AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND fail), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fail AND NOT reached), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (reached AND fail), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (reached AND fail), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
