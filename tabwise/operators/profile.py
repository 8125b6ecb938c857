"""Column profile: one value-count shuffle feeds types, distinct counts, personal-data
patterns, date parts and labels of every column.

``value_counts`` turns the table into (column, value, n, first_row) with partial
aggregation before the shuffle, so a value that fills a third of the table travels as one
row per task.  Everything after that works on distinct values, not on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabwise.functions import fixed as V
from tabwise.functions.exprs import (
    as_double, as_text, is_numeric, label_by_header, pii_by_header, q, share, strip_number,
)
from tabwise.session import local_table

ROW_ID = "_row_id"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def value_counts(df: DataFrame, columns: list[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """(column, value, n, first_row): how often each value occurs and where first."""
    columns = columns or data_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    rid = q(row_id) if row_id in df.columns else F.lit(None).cast("long")
    text = df.select(rid.alias("__rid"), *[as_text(c, types[c]).alias(c) for c in columns])
    return (
        text.unpivot(["__rid"], [q(c) for c in columns], "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.min("__rid").alias("first_row"))
    )


def first_values(df: DataFrame, n: int, columns: list[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """(column, value, n=1, first_row) of the first ``n`` non-null values per column.

    The per-column top-n is cut inside each task before the shuffle (window group limit).
    """
    columns = columns or data_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    text = df.select(q(row_id).alias("first_row"), *[as_text(c, types[c]).alias(c) for c in columns])
    rows = text.unpivot(["first_row"], [q(c) for c in columns], "column", "value").where("value is not null")
    w = Window.partitionBy("column").orderBy("first_row")
    return (
        rows.withColumn("_k", F.row_number().over(w))
        .where(F.col("_k") <= n)
        .select("column", "value", F.lit(1).cast("long").alias("n"), "first_row")
    )


def _schema_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: position, name and physical kind (size = number of columns)."""

    def kind(dt: T.DataType) -> str:
        if isinstance(dt, T.BooleanType):
            return "bool"
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        return "int" if is_numeric(dt) else "text"

    fields = {f.name: f.dataType for f in df.schema.fields}
    rows = [(i, c, fields[c].simpleString(), kind(fields[c])) for i, c in enumerate(columns)]
    return local_table(df.sparkSession, rows, "ordinal int, name string, dtype_raw string, kind string")


def column_facts(
    df: DataFrame,
    columns: list[str] | None = None,
    counts: DataFrame | None = None,
    sample_rows: bool = False,
    row_id: str = ROW_ID,
) -> DataFrame:
    """One row of raw facts per column.

    By default every row counts.  ``sample_rows=True`` looks at the leading non-null rows
    only for the pattern shares (30 for types, 50 for personal data, 40 for labels).
    """
    columns = columns or data_columns(df)
    counts = value_counts(df, columns, row_id) if counts is None else counts
    v, n = F.col("value"), F.col("n")
    t = F.trim(v)
    low = F.lower(t)
    num = strip_number(v)
    some = v.isNotNull()

    base_rules = _base_aggs(v, n, low, num, some)

    def patterns(source: DataFrame, **rules) -> DataFrame:
        return source.groupBy("column").agg(
            *[F.coalesce(F.sum(F.when(some & cond, n)), F.lit(0)).alias(k) for k, cond in rules.items()],
            F.coalesce(F.sum(F.when(some, n)), F.lit(0)).alias("_seen"),
        )

    digit = t.rlike(r"\d{3}")
    type_rules = {"s_date": v.rlike(V.DATE_LIKE)}
    pii_rules = {
        "s_email": t.contains("@") & t.rlike(V.EMAIL_VALUE),
        "s_phone": digit & t.rlike(V.PHONE_VALUE),
        "s_card": digit & t.rlike(V.CARD_VALUE),
        "s_ssn": digit & (t.rlike(V.SSN_VALUE) | t.rlike(V.NATIONAL_12_VALUE)),
    }
    label_rules = {
        "l_uuid": t.rlike(V.UUID_VALUE),
        "l_email": t.contains("@") & t.rlike(V.EMAIL_VALUE),
        "l_phone": digit & t.rlike(V.PHONE_VALUE),
        "l_currency": t.rlike(V.CURRENCY_VALUE),
    }
    if sample_rows:
        lead = first_values(df, V.SAMPLE_PII_ROWS, columns, row_id)
        w = Window.partitionBy("column").orderBy("first_row")
        lead = lead.withColumn("_k", F.row_number().over(w))
        parts = [
            patterns(lead.where(F.col("_k") <= V.SAMPLE_TYPE_ROWS), **type_rules).withColumnRenamed("_seen", "seen_type"),
            patterns(lead.where(F.col("_k") <= V.SAMPLE_PII_ROWS), **pii_rules).withColumnRenamed("_seen", "seen_pii"),
            patterns(lead.where(F.col("_k") <= V.SAMPLE_LABEL_ROWS), **label_rules).withColumnRenamed("_seen", "seen_label"),
        ]
        base = counts.groupBy("column").agg(*_agg_columns(base_rules, {}, n, some))
        for p in parts:
            base = base.join(p, "column", "left")
    else:
        # Same aggregation, same shuffle: all shares in one pass over the value counts.
        rules = {**type_rules, **pii_rules, **label_rules}
        base = counts.groupBy("column").agg(*_agg_columns(base_rules, rules, n, some))
        for seen in ("seen_type", "seen_pii", "seen_label"):
            base = base.withColumn(seen, F.col("n_rows") - F.col("null_count"))
    return _schema_rows(df, columns).join(base.withColumnRenamed("column", "name"), "name", "left")


def _base_aggs(v, n, low, num, some) -> dict:
    words = V.BOOL_TRUE + V.BOOL_FALSE

    def weight(cond):
        return F.coalesce(F.sum(F.when(some & cond, n)), F.lit(0))

    return {
        "n_rows": F.sum(n),
        "null_count": F.coalesce(F.sum(F.when(~some, n)), F.lit(0)),
        "unique_count": F.count(v),
        "n_not_bool": weight(~low.isin(words)),
        "n_bool_words": F.size(F.collect_set(F.when(low.isin(words), low))),
        "n_number": weight(num.isNotNull()),
        "n_fraction": weight(num.isNotNull() & (F.abs(num) % 1 != 0)),
        "min_value": F.min(num),
        "max_value": F.max(num),
        "mean_value": F.try_divide(F.sum(num * n), F.sum(F.when(num.isNotNull(), n))),
    }


def _agg_columns(base_rules: dict, pattern_rules: dict, n, some) -> list:
    return [c.alias(k) for k, c in base_rules.items()] + [
        F.coalesce(F.sum(F.when(some & cond, n)), F.lit(0)).alias(k) for k, cond in pattern_rules.items()
    ]


def logical_type(facts: DataFrame) -> DataFrame:
    """Add ``dtype_inferred``: bool, string, date, int, float or category."""
    filled = F.col("n_rows") - F.col("null_count")
    text = F.col("kind") == "text"
    numeric = (F.col("kind") == "float") | (text & (share(F.col("n_number"), filled) >= 0.90))
    kind = (
        F.when(F.col("kind") == "bool", "bool")
        .when(filled == 0, "string")
        .when(text & (F.col("n_not_bool") == 0) & (F.col("n_bool_words") <= 2), "bool")
        .when(F.col("kind") == "date", "date")
        .when(text & (share(F.col("s_date"), F.col("seen_type")) >= 0.75), "date")
        .when(F.col("kind") == "int", "int")
        .when(numeric & (F.col("n_fraction") == 0), "int")
        .when(numeric, "float")
        .when(
            (F.col("unique_count") <= 20)
            | ((share(F.col("unique_count"), filled) <= 0.05) & (F.col("unique_count") < 100)),
            "category",
        )
        .otherwise("string")
    )
    return facts.withColumn("dtype_inferred", kind)


def pii_flags(facts: DataFrame) -> DataFrame:
    """Add ``is_pii`` and ``pii_type``: header rules first, then value shares >= 50 %."""
    header = pii_by_header(F.col("name"))

    def often(c):
        return (F.col("seen_pii") > 0) & (share(F.col(c), F.col("seen_pii")) >= V.PII_VALUE_SHARE)

    found = (
        F.when(header.isNotNull(), header)
        .when(often("s_email"), "email")
        .when(often("s_phone"), "phone")
        .when(often("s_card"), "credit_card")
        .when(often("s_ssn"), "ssn_national_id")
        .otherwise("none")
    )
    return facts.withColumn("pii_type", found).withColumn("is_pii", F.col("pii_type") != "none")


def semantic_labels(facts: DataFrame) -> DataFrame:
    """Add ``semantic_label``, ``confidence`` and ``method_used``."""
    header = label_by_header(F.col("name"))

    def often(c, limit):
        return (F.col("seen_label") > 0) & (share(F.col(c), F.col("seen_label")) >= limit)

    ages = (
        F.col("kind").isin("int", "float")
        & (F.col("n_number") > 0)
        & (F.col("min_value") >= 0)
        & (F.col("max_value") <= 120)
        & (F.col("n_fraction") == 0)
    )
    age_name = ages & F.lower("name").contains("age")
    age_mean = ages & (F.col("mean_value") > 10) & (F.col("mean_value") < 70)

    def pick(label, conf, how):
        return F.struct(
            F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"),
            F.lit(conf).alias("conf"),
            F.lit(how).alias("how"),
        )

    s = (
        F.when(header.isNotNull(), pick(header, 0.90, "rule"))
        .when(often("l_uuid", 0.70), pick("identifier", 0.85, "pattern"))
        .when(often("l_email", 0.70), pick("email", 0.85, "pattern"))
        .when(often("l_phone", 0.70), pick("phone", 0.85, "pattern"))
        .when(often("l_currency", 0.60), pick("currency_amount", 0.80, "pattern"))
        .when(age_name, pick("age", 0.90, "rule"))
        .when(age_mean, pick("age", 0.75, "pattern"))
        .when(F.col("is_pii"), pick("unknown", 0.40, "pii_blocked"))
        .otherwise(pick("unknown", 0.40, "rule"))
    )
    return (
        facts.withColumn("_s", s)
        .withColumn("semantic_label", F.col("_s.label"))
        .withColumn("confidence", F.col("_s.conf"))
        .withColumn("method_used", F.col("_s.how"))
        .drop("_s")
    )


def target_flags(facts: DataFrame) -> DataFrame:
    """Add ``is_target_candidate``."""
    few = F.col("unique_count").between(2, 10)
    return facts.withColumn(
        "is_target_candidate",
        F.col("semantic_label").isin(V.OUTCOME_LABELS)
        | (
            F.col("dtype_inferred").isin("category", "int", "float")
            & few & ~F.col("is_pii") & (F.col("null_pct") < 0.20)
        ),
    )


PROFILE_COLUMNS = [
    "ordinal", "name", "dtype_raw", "dtype_inferred", "semantic_label", "confidence", "method_used",
    "is_pii", "pii_type", "n_rows", "null_count", "null_pct", "unique_count", "is_constant", "is_empty",
    "is_target_candidate",
]


def profile_columns(
    df: DataFrame, columns: list[str] | None = None, sample_rows: bool = False, row_id: str = ROW_ID,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The column catalogue: one row per column with every profile decision."""
    f = column_facts(df, columns, counts, sample_rows, row_id)
    f = f.withColumn("null_pct", F.round(share(F.col("null_count"), F.col("n_rows")), 4))
    f = f.withColumn("is_constant", (F.col("unique_count") <= 1) & (F.col("null_count") == 0))
    f = f.withColumn("is_empty", F.col("null_count") == F.col("n_rows"))
    f = target_flags(semantic_labels(pii_flags(logical_type(f))))
    return f.select(*PROFILE_COLUMNS)


def duplicate_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, duplicate_rows, duplicate_pct): exact copies beyond the first."""
    columns = columns or data_columns(df)
    groups = df.groupBy(*[q(c) for c in columns]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_pct", F.round(share(F.col("duplicate_rows"), F.col("n_rows")), 4))


def approx_profile(df: DataFrame, columns: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """(name, n_rows, null_count, unique_count) without any value shuffle: sketches only."""
    columns = columns or data_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count(as_text(c, types[c])).alias(f"f{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(as_text(c, types[c]), rsd).alias(f"u{i}") for i, c in enumerate(columns)],
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("name"), F.col("n").alias("n_rows"),
                        (F.col("n") - F.col(f"f{i}")).alias("null_count"), F.col(f"u{i}").alias("unique_count"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def column_inventory(profile: DataFrame) -> DataFrame:
    """Display view of the catalogue: counts and null percentage, nothing sensitive."""
    return profile.orderBy("ordinal").select(
        "name", "dtype_inferred", "semantic_label", "is_pii", "null_count",
        F.round(F.col("null_pct") * 100, 2).alias("null_percent"), "unique_count",
    )


# --- domain and quality -------------------------------------------------------

def domain_votes(profile: DataFrame) -> DataFrame:
    """(domain, score): 2 for a label that is a keyword, else 1 for a header holding one."""
    label, name = F.lower(F.trim("semantic_label")), F.lower(F.trim("name"))
    votes = []
    for domain, words in V.DOMAIN_KEYWORDS.items():
        in_name = F.lit(False)
        for w in words:
            in_name = in_name | name.contains(w)
        votes.append(F.struct(F.lit(domain).alias("domain"), F.when(label.isin(words), 2).when(in_name, 1).otherwise(0).alias("v")))
    return (
        profile.select(F.explode(F.array(*votes)).alias("e"))
        .groupBy(F.col("e.domain").alias("domain"))
        .agg(F.sum("e.v").alias("score"))
    )


def classify_domain(profile: DataFrame) -> DataFrame:
    """(domain, confidence): the winner needs 2 points; ties go retail, healthcare, finance."""
    order = F.when(F.col("domain") == "retail", 3).when(F.col("domain") == "healthcare", 2).otherwise(1)
    best = domain_votes(profile).agg(
        F.max_by("domain", F.struct("score", order)).alias("best"),
        F.max("score").alias("top"),
        F.sum("score").alias("total"),
    )
    won = F.col("top") >= 2
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.70), F.bround(F.try_divide("top", "total"), 2)))
    return best.select(
        F.when(won, F.col("best")).otherwise("generic").alias("domain"),
        F.when(won, conf).otherwise(0.50).alias("confidence"),
    )


def quality_score(profile: DataFrame, dates: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: score 0-100 and the shares behind it."""
    cols = profile.agg(
        F.count("*").alias("n_cols"),
        F.coalesce(F.avg("null_pct"), F.lit(0.0)).alias("avg_null"),
        F.count_if(F.col("confidence") < 0.70).alias("low_confidence_columns"),
    )
    vague = F.col("needs_confirmation") | (F.col("detected_format") == "ambiguous")
    d = dates.agg(F.count("*").alias("n_dates"), F.count_if(vague).alias("ambiguous_dates"))
    one = cols.join(F.broadcast(d), how="cross").join(F.broadcast(duplicates.select("duplicate_pct")), how="cross")
    raw = (
        F.lit(100.0)
        - F.col("avg_null") * 30.0
        - F.col("duplicate_pct") * 20.0
        - share(F.col("ambiguous_dates"), F.col("n_dates")) * 15.0
        - share(F.col("low_confidence_columns"), F.col("n_cols")) * 15.0
    )
    return one.select(
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int").alias("score"),
        F.round("avg_null", 4).alias("avg_null_pct"),
        F.round("duplicate_pct", 4).alias("duplicate_row_pct"),
        "ambiguous_dates",
        "low_confidence_columns",
    )


def quality_issues(profile: DataFrame, dates: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(kind_no, ordinal, issue): nulls, duplicates, vague dates, unsure labels, in order."""
    nulls = profile.where("null_pct >= 0.05").select(
        F.lit(1).alias("kind_no"), "ordinal",
        F.format_string("%s%% null values in column '%s'", F.round(F.col("null_pct") * 100, 1).cast("string"), "name").alias("issue"),
    )
    dup = duplicates.where("duplicate_pct > 0").select(
        F.lit(2).alias("kind_no"), F.lit(0).alias("ordinal"),
        F.format_string("Duplicate rows detected (%s%% of dataset)", F.round(F.col("duplicate_pct") * 100, 1).cast("string")).alias("issue"),
    )
    vague = dates.where("needs_confirmation or detected_format = 'ambiguous'").select(
        F.lit(3).alias("kind_no"), "ordinal",
        F.format_string("Ambiguous date format in column '%s' (requires confirmation)", "column").alias("issue"),
    )
    unsure = profile.where("confidence < 0.70").select(
        F.lit(4).alias("kind_no"), "ordinal",
        F.format_string("Low-confidence semantic label in column '%s' (confidence: %s)", "name", F.col("confidence").cast("string")).alias("issue"),
    )
    return nulls.unionByName(dup).unionByName(vague).unionByName(unsure).orderBy("kind_no", "ordinal")
