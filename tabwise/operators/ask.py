"""Questions over a table: classify, shield, answer, as one batch.

The question table may be long; the table asked about may be huge.  Classification is a
projection over the questions.  Only the distinct (operation, column, group) triples are
read by the driver; all scalar answers share one aggregation of the data table and all
grouped answers share one shuffle.  Refused questions never reach the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import as_double, as_text, is_numeric, q, screen_message, shielded, shielded_by_header
from tabwise.operators.profile import data_columns
from tabwise.operators.quantiles import exact_quantiles
from tabwise.session import checkpoint_cut, local_table, once

EDGE = "\u0001"  # marks word boundaries inside texts and column names
HOT_QUESTIONS = 1_000
MAX_PLANS = 10_000

# Question grammar (fixed values): operation -> words, in order of precedence.
WORDS = {
    "mean": r"mean|average|avg",
    "sum": r"sum|total",
    "median": r"median",
    "std": r"standard\s+deviation|std\s+dev|stddev|stdev|std",
    "variance": r"variance|var",
    "min": r"min|minimum|lowest|smallest",
    "max": r"max|maximum|highest|largest",
}
ROW_COUNT = r"\b(?:how many rows|total rows|row count|number of rows|count of rows)\b"
BY = r"(?:grouped by|by|per|for each)"
VALUE_COUNTS = [
    r"(?:value\s*counts?|distribution|breakdown|frequencies|frequency|categories)\s+(?:of|for|in)?\s*(.+)",
    r"(?:most\s+common|most\s+frequent|top\s+values?|frequent)\s+(?:of\s+|in\s+)?(.+)",
    r"(.+?)\s+distributed",
]


def _forms() -> list[tuple[str, str, int, int]]:
    """(operation, pattern, group of the column text, group of the key text or 0)."""
    forms = []
    for op, word in (("groupby_mean", "mean"), ("groupby_sum", "sum")):
        w = WORDS[word]
        forms.append((op, rf"(?:{w})\s+(?:of\s+)?(.+?)\s+{BY}\s+(.+)", 1, 2))
        forms.append((op, rf"(?:group by|groupby)\s+(.+?)\s+(?:and calculate|and find|with)?\s*(?:the\s+)?(?:{w})\s+(?:of\s+)?(.+)", 2, 1))
    forms += [("value_counts", p, 1, 0) for p in VALUE_COUNTS]
    for op in ("median", "std", "variance", "mean", "sum", "min", "max"):
        w = WORDS[op]
        lead = r"(?:value\s+of\s+|of\s+)?" if op in ("min", "max") else r"(?:of\s+)?"
        forms.append((op, rf"(?:{w})\s+{lead}(.+)", 1, 0))
        forms.append((op, rf"(.+?)\s+(?:{w})\b", 1, 0))
    return forms


COUNT_FORMS = [r"(?:count|number)\s+(?:of\s+)?(.+)", r"how many\s+(.+)"]


def _marked(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\b", EDGE)


def find_column(marked: Column, columns: list[str]) -> Column:
    """Longest column name that stands in a marked text as a whole word, else NULL.

    Word boundaries were marked once per text; each name is then a plain substring test.
    """
    keys = sorted(columns, key=len, reverse=True)
    table = F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(re.sub(r"\b", EDGE, c.lower())).alias("key")) for c in keys
    ])
    return F.get(F.filter(table, lambda c: F.contains(marked, c["key"])), F.lit(0)).getField("name")


def classify_questions(questions: DataFrame, columns: list[str], text: str = "text", operations: list[str] | None = None) -> DataFrame:
    """Add ``operation``, ``column``, ``group_column``; 'unclassified' where nothing fits."""
    allowed = set(operations or V.OPERATIONS)
    low = F.lower(F.trim(q(text)))
    forms = [f for f in _forms() if f[0] in allowed]

    def form(op, pattern, col_at, key_at):
        return F.struct(
            F.lit(op).alias("op"),
            _marked(F.regexp_extract(low, pattern, col_at)).alias("col_text"),
            (_marked(F.regexp_extract(low, pattern, key_at)) if key_at else F.lit(None).cast("string")).alias("key_text"),
            F.lit(bool(key_at)).alias("grouped"),
        )

    def found(array: Column) -> Column:
        named = F.transform(
            F.filter(array, lambda e: e["col_text"] != ""),
            lambda e: F.struct(
                e["op"].alias("op"),
                find_column(e["col_text"], columns).alias("column"),
                F.when(e["grouped"], find_column(e["key_text"], columns)).alias("group_column"),
                e["grouped"].alias("grouped"),
            ),
        )
        good = F.filter(
            named,
            lambda e: e["column"].isNotNull()
            & (~e["grouped"] | (e["group_column"].isNotNull() & (e["group_column"] != e["column"]))),
        )
        return F.get(good, F.lit(0))

    first = found(F.array(*[form(*f) for f in forms]))
    counted = found(F.array(*[form("count", p, 1, 0) for p in COUNT_FORMS]))
    rows = low.rlike(ROW_COUNT)
    can_count = "count" in allowed
    none = F.lit(None).cast("string")

    def triple(op, c, g):
        return F.struct(op.alias("operation"), c.alias("column"), g.alias("group_column"))

    a, b = F.col("_a"), F.col("_b")
    pick = F.when(a.isNotNull(), triple(a["op"], a["column"], a["group_column"]))
    if can_count:
        pick = pick.when(F.col("_rows"), triple(F.lit("count"), none, none))
        pick = pick.when(b.isNotNull(), triple(F.lit("count"), b["column"], none))
    pick = pick.otherwise(triple(F.lit("unclassified"), none, none))
    judged = once(questions, F.struct(first.alias("_a"), counted.alias("_b"), rows.alias("_rows")))
    return once(judged, pick).drop("_a", "_b", "_rows")


def sensitive_columns(profile: DataFrame) -> DataFrame:
    """(ordinal, name, sensitive): the shield over the column catalogue."""
    return profile.select(
        "ordinal", "name",
        shielded(F.col("name"), F.col("is_pii"), F.col("semantic_label"), F.col("pii_type")).alias("sensitive"),
    )


def mentions(text: Column, names: list[str]) -> Column:
    """First of ``names`` that a free text mentions, singular or plural, else NULL."""
    if not names:
        return F.lit(None).cast("string")
    low = F.lower(text)
    parts = []
    for c in names:
        full = c.lower()
        stem = full[:-1] if full.endswith("s") else full
        pattern = rf"(?U)(?:\b|['\"])(?:{_quote(full)}|{_quote(stem)}s?)(?:\b|['\"])"
        parts.append(F.when(low.rlike(pattern), F.lit(c)))
    return F.coalesce(*parts)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def judge_questions(classified: DataFrame, sensitive: list[str], numeric: list[str], text: str = "text") -> DataFrame:
    """Add ``status``: refusal, unavailable, error, success or free, before any data access."""
    hidden = F.array(*[F.lit(c) for c in sensitive]) if sensitive else F.array().cast("array<string>")
    op, c, g = F.col("operation"), F.col("column"), F.col("group_column")

    def blocked(name: Column) -> Column:
        return F.coalesce(F.array_contains(hidden, name) | shielded_by_header(name), F.lit(False))

    needs_number = ~op.isin("count", "value_counts")
    numbers = F.array(*[F.lit(x) for x in numeric]) if numeric else F.array().cast("array<string>")
    status = (
        F.when(F.trim(q(text)) == "", "unavailable")
        .when(screen_message(q(text)).isNotNull(), "refusal")
        .when((op == "unclassified") & mentions(q(text), sensitive).isNotNull(), "refusal")
        .when(op == "unclassified", "free")
        .when((op == "count") & c.isNull(), "success")
        .when(c.isNull(), "unavailable")
        .when(blocked(c), "refusal")
        .when(op.startswith("groupby") & blocked(g), "refusal")
        .when(needs_number & ~F.array_contains(numbers, c), "error")
        .otherwise("success")
    )
    return once(classified, F.struct(status.alias("status")))


def _scalar(op: str, x: Column, c: Column) -> Column:
    n = F.count(x)
    return {
        "mean": F.avg(x),
        "sum": F.coalesce(F.sum(x), F.lit(0.0)),
        "count": F.count(c).cast("double"),
        "min": F.min(x),
        "max": F.max(x),
        "std": F.when(n > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))),
        "variance": F.when(n > 0, F.coalesce(F.var_samp(x), F.lit(0.0))),
    }[op]


def aggregate(df: DataFrame, operation: str, column: str | None = None, group_column: str | None = None, by_value: bool = False) -> DataFrame:
    """One whitelisted operation: (value) for scalars, (key, value) for the others.

    Grouped results keep the first ten keys in key order (``by_value``: the ten largest).
    """
    if operation not in V.OPERATIONS:
        raise ValueError(f"operation '{operation}' is not supported")
    types = {f.name: f.dataType for f in df.schema.fields}
    if operation == "count" and column is None:
        return df.agg(F.count("*").cast("double").alias("value"))
    x = as_double(column, types[column])
    if operation == "value_counts":
        v = F.trim(as_text(column, types[column]))
        return (
            df.select(v.alias("key")).where("key is not null and key <> ''").groupBy("key")
            .agg(F.count("*").alias("value")).orderBy(F.desc("value"), "key").limit(10)
        )
    if operation in ("groupby_mean", "groupby_sum"):
        how = F.avg("x") if operation == "groupby_mean" else F.sum("x")
        rows = df.select(as_text(group_column, types[group_column]).alias("key"), x.alias("x")).where("key is not null and x is not null")
        out = rows.groupBy("key").agg(F.round(how, 4).alias("value"))
        return out.orderBy(*([F.desc("value"), "key"] if by_value else ["key"])).limit(10)
    if operation == "median":
        m = exact_quantiles(df, [column], [0.5])[column][0]
        return local_table(df.sparkSession, [(None if m is None else round(m, 4),)], "value double")
    return df.agg(F.round(_scalar(operation, x, q(column)), 4).alias("value"))


def answer_plans(df: DataFrame, plans: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """(operation, column, group_column, value, entries) for distinct, permitted plans."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = "operation string, column string, group_column string, value double, entries array<struct<key:string,value:double>>"
    scalars = [p for p in plans if p[0] in ("mean", "sum", "count", "min", "max", "std", "variance")]
    medians = sorted({p[1] for p in plans if p[0] == "median"})
    grouped = [p for p in plans if p[0] in ("groupby_mean", "groupby_sum", "value_counts")]
    rows = []
    if scalars:
        aggs = []
        for i, (op, c, _) in enumerate(scalars):
            e = F.count("*").cast("double") if c is None else _scalar(op, as_double(c, types[c]), q(c))
            aggs.append(F.round(e, 4).alias(f"a{i}"))
        for k in range(0, len(aggs), 100):
            r = df.agg(*aggs[k : k + 100]).first()
            rows += [(*p, r[i], None) for i, p in enumerate(scalars[k : k + 100])]
    if medians:
        got = exact_quantiles(df, medians, [0.5])
        rows += [("median", c, None, None if got[c][0] is None else round(got[c][0], 4), None) for c in medians]
    out = local_table(spark, rows, schema)
    if grouped:
        cells = []
        for i, (op, c, g) in enumerate(grouped):
            key = F.trim(as_text(c, types[c])) if op == "value_counts" else as_text(g, types[g])
            x = F.lit(1.0) if op == "value_counts" else as_double(c, types[c])
            cells.append(F.struct(F.lit(i).alias("p"), key.alias("key"), x.alias("x")))
        counts = [i for i, p in enumerate(grouped) if p[0] == "value_counts"]
        means = [i for i, p in enumerate(grouped) if p[0] == "groupby_mean"]
        is_count = F.col("p").isin(counts) if counts else F.lit(False)
        is_mean = F.col("p").isin(means) if means else F.lit(False)
        sums = (
            df.select(F.inline(F.array(*cells))).where("key is not null and x is not null")
            .where(~is_count | (F.col("key") != ""))
            .groupBy("p", "key").agg(F.sum("x").alias("s"), F.avg("x").alias("m"))
            .select("p", "key", F.when(is_mean, F.round("m", 4)).otherwise(F.round("s", 4)).alias("value"))
        )
        place = F.when(is_count, -F.col("value")).otherwise(0.0)
        w = Window.partitionBy("p").orderBy(place, "key")
        tops = (
            sums.withColumn("k", F.row_number().over(w)).where("k <= 10")
            .groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "key", "value"))).alias("e"))  # ten at most
        )
        names = local_table(spark, [(i, *p) for i, p in enumerate(grouped)], "p int, operation string, column string, group_column string")
        out = out.unionByName(names.join(tops, "p", "left").select(
            "operation", "column", "group_column", F.lit(None).cast("double").alias("value"),
            F.transform("e", lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"))).alias("entries"),
        ))
    return out


_NOUNS = {
    "mean": "mean", "sum": "sum", "min": "minimum value", "max": "maximum value", "median": "median",
    "std": "standard deviation", "variance": "variance",
}


def response_text(op: Column, c: Column, g: Column, value: Column, entries: Column, status: Column) -> Column:
    noun = F.create_map(*[F.lit(x) for kv in _NOUNS.items() for x in kv])[op]
    lines = F.concat_ws("\n", F.transform(entries, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"].cast("string"))))
    return (
        F.when((status == "refusal") & c.isNotNull(), F.format_string("Refusal: '%s' holds sensitive personal data or identifiers.", c))
        .when(status == "refusal", "Refusal: this request is not permitted.")
        .when(status == "unavailable", "The requested information is not available.")
        .when(status == "error", F.format_string("Column '%s' is not numeric.", c))
        .when(status == "free", F.lit(None).cast("string"))
        .when((op == "count") & c.isNull(), F.format_string("The dataset contains %d rows.", value.cast("long")))
        .when(op == "count", F.format_string("The count of non-null values in '%s' is %d.", c, value.cast("long")))
        .when(op == "value_counts", F.concat(F.format_string("Top categories in '%s':\n", c), lines))
        .when(op.startswith("groupby"), F.concat(F.format_string("'%s' by '%s':\n", c, g), lines))
        .when(value.isNull(), F.format_string("Column '%s' contains zero valid numeric entries.", c))
        .otherwise(F.concat(F.lit("The "), noun, F.lit(" of '"), c, F.lit("' is "), value.cast("string"), F.lit(".")))
    )


def answer_questions(df: DataFrame, profile: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """Every question with operation, columns, status, value, entries and response."""
    names = data_columns(df)
    hidden = [r["name"] for r in sensitive_columns(profile).where("sensitive").orderBy("ordinal").collect()]
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    # every distinct text is judged once; the judgements are read twice below
    judged = checkpoint_cut(judge_questions(classify_questions(questions.select(q(text)).distinct(), names, text), hidden, numeric, text))
    plans = sorted(
        ((r["operation"], r["column"], r["group_column"]) for r in judged.where("status = 'success'").select("operation", "column", "group_column").distinct().toLocalIterator()),
        key=str,
    )
    answers = answer_plans(df, plans[:MAX_PLANS])
    for at in range(MAX_PLANS, len(plans), MAX_PLANS):
        answers = answers.unionByName(answer_plans(df, plans[at:at + MAX_PLANS]))
    a = answers.select(
        F.col("operation").alias("_o"), F.col("column").alias("_c"), F.col("group_column").alias("_g"), "value", "entries"
    )
    # One row per distinct plan, broadcast up to MAX_PLANS of them.
    joined = judged.join(
        F.broadcast(a) if len(plans) <= MAX_PLANS else a,
        (F.col("status") == "success") & (F.col("operation") == F.col("_o"))
        & F.col("column").eqNullSafe(F.col("_c")) & F.col("group_column").eqNullSafe(F.col("_g")),
        "left",
    ).drop("_o", "_c", "_g")
    told = [c for c in joined.columns if c != text]
    again = joined.withColumnRenamed(text, "_text")
    joined = _back_to(questions, again, text, told)
    return joined.withColumn(
        "response",
        response_text(F.col("operation"), F.col("column"), F.col("group_column"), F.col("value"), F.col("entries"), F.col("status")),
    )


def _back_to(questions: DataFrame, judged: DataFrame, text: str, told: list[str]) -> DataFrame:
    """The judgement of every question's text beside it.

    A text that more than one in HOT_QUESTIONS of all questions share is joined by broadcast, the others by shuffle.
    """
    counts = questions.groupBy(q(text).alias("_hot")).agg(F.count("*").alias("_n"))
    hot = checkpoint_cut(counts.where(F.col("_n") > F.lit(questions.count() / HOT_QUESTIONS)).select("_hot", F.lit(True).alias("_is_hot")))  # HOT_QUESTIONS rows at most
    marked = questions.join(F.broadcast(hot), questions[text].eqNullSafe(F.col("_hot")), "left")
    few = judged.join(F.broadcast(hot), F.col("_text").eqNullSafe(F.col("_hot")), "left_semi")
    parts = []
    for own, side in ((F.col("_is_hot"), F.broadcast(few)), (F.col("_is_hot").isNull(), judged)):
        rows = marked.where(own).drop("_hot", "_is_hot")
        parts.append(rows.join(side, rows[text].eqNullSafe(F.col("_text")), "left").select(*[rows[c] for c in questions.columns], *told))
    return parts[0].unionByName(parts[1])


def lookup_topic(text: Column) -> Column:
    """Topic of a free question answered from facts, by keyword, in order."""
    low = F.lower(text)

    def has(*words):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit

    return (
        F.when(has("quality", "score", "cleanliness"), "quality")
        .when(has("domain", "industry", "business context"), "domain")
        .when(has("model", "ml", "algorithm", "predict", "train"), "model")
        .when(has("rows", "records", "columns", "size"), "shape")
        .when(has("insight", "finding", "recommendation", "takeaway"), "insights")
        .when(has("target", "candidate"), "targets")
        .otherwise("none")
    )


def answer_from_facts(questions: DataFrame, facts: DataFrame, text: str = "text") -> DataFrame:
    """Join free questions to one-line fact answers (topic, answer); six topics at most."""
    return questions.withColumn("topic", lookup_topic(q(text))).join(F.broadcast(facts), "topic", "left").withColumn(
        "answer", F.coalesce("answer", F.lit("The requested information is not available."))
    )


def suggested_questions(profile: DataFrame) -> DataFrame:
    """(place, question): starters built from safe columns only."""
    safe = profile.where(~F.col("is_pii") & (F.col("semantic_label") != "identifier"))
    number = F.col("dtype_inferred").isin("int", "float")
    lead = safe.agg(
        F.slice(F.array_sort(F.collect_list(F.when(number, F.struct("ordinal", "name")))), 1, 2).alias("nums"),
        F.min(F.when(~number, F.struct("ordinal", "name"))).getField("name").alias("cat"),
    ).select(F.get("nums", F.lit(0)).getField("name").alias("n1"), F.get("nums", F.lit(1)).getField("name").alias("n2"), "cat")
    asks = F.array(
        F.struct(F.lit(1).alias("place"), F.lit("What is the overall data quality score and key issues?").alias("question")),
        F.struct(F.lit(2).alias("place"), F.lit("What were the key findings and executive insights?").alias("question")),
        F.struct(F.lit(3).alias("place"), F.lit("What was the machine learning model training outcome?").alias("question")),
        F.struct(F.lit(4).alias("place"), F.concat(F.lit("What is the average "), "n1", F.lit("?")).alias("question")),
        F.struct(F.lit(5).alias("place"), F.concat(F.lit("What is the maximum "), "n1", F.lit("?")).alias("question")),
        F.struct(F.lit(6).alias("place"), F.concat(F.lit("What is the median "), "n2", F.lit("?")).alias("question")),
        F.struct(F.lit(7).alias("place"), F.concat(F.lit("What is the distribution of "), "cat", F.lit("?")).alias("question")),
        F.struct(F.lit(8).alias("place"), F.concat(F.lit("Average "), "n1", F.lit(" by "), "cat").alias("question")),
    )
    return lead.select(F.inline(asks)).where("question is not null")

