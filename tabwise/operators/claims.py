"""Are the numbers in a text backed by computed facts?

Facts of one dataset are few (statistics per column, correlations per pair); claims can
be many.  Only the nearest facts of a number can ground it, because each tolerance test
gets harder with distance: a number is judged by binary search in short sorted arrays, or,
where a dataset has very many facts, by a sorted merge.  No claim x fact pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwise.functions import fixed as V
from tabwise.functions.exprs import count_at_most, numbers_in, q
from tabwise.operators.quantiles import RANGE_ROWS, order_ranges, range_no
from tabwise.session import checkpoint_cut, once

FEW_FACTS = 100_000  # per dataset; with more, numbers and facts are merged by sorting
SENT_FACTS = 1_000_000  # of all datasets; so many are sent to the tasks that hold claims


def typed_facts(facts: DataFrame, dataset: str = "dataset_id", value: str = "value") -> DataFrame:
    """(dataset, kind, x): distinct facts as whole numbers, fractions and percentages of proportions.

    A column ``is_int`` of the facts says which are whole numbers; without it (or where it is NULL) the value does.
    """
    x = q(value).cast("double")
    whole = F.coalesce(F.col("is_int"), x % 1 == 0) if "is_int" in facts.columns else x % 1 == 0
    kinds = F.array(
        F.struct(F.when(whole, "int").otherwise("float").alias("kind"), x.alias("x")),
        F.when(~whole & (x > 0) & (x <= 1), F.struct(F.lit("share").alias("kind"), (x * 100.0).alias("x"))),
    )
    rows = facts.where(x.isNotNull() & ~F.isnan(x)).select(q(dataset).alias(dataset), F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e"))
    return rows.select(dataset, "e.kind", "e.x").distinct()


def fact_arrays(typed: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """(dataset, ints, floats, shares) as sorted arrays; only for datasets of few facts."""
    def pick(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("x"))))

    return typed.groupBy(dataset).agg(pick("int").alias("ints"), pick("float").alias("floats"), pick("share").alias("shares"))


def neighbours(array: Column, x: Column, bound: int = FEW_FACTS) -> Column:
    """The neighbours of ``x`` in a sorted array, at or below and above: one or two elements.

    ``bound`` is the length of the longest array that occurs.
    """
    return F.slice(array, F.greatest(count_at_most(array, x, bound=bound), F.lit(1)), F.lit(2))


def near_enough(x: Column, ints: Column, floats: Column, shares: Column, tolerance: float = 0.05) -> Column:
    """One number against arrays of its nearest facts of each kind.

    Equal to a whole fact within 0.01; to a fraction within 0.02 or the relative
    tolerance; to a proportion's percentage within 0.5 or the relative tolerance.
    """
    def off(f):
        return F.abs(x - f)

    return (
        F.exists(ints, lambda f: off(f) <= 0.01)
        | F.exists(floats, lambda f: (off(f) <= 0.02) | (F.coalesce(F.try_divide(off(f), F.abs(f)), off(f)) <= tolerance))
        | F.exists(shares, lambda f: (off(f) <= 0.5) | (F.try_divide(off(f), f) <= tolerance))
    )


def _bad_by_arrays(claims: DataFrame, typed: DataFrame, dataset: str, tolerance: float, most: int, send: bool = True) -> DataFrame:
    """Add ``ungrounded`` by binary search; one short row per dataset joins the claims.

    With ``send`` the facts go to the claims: datasets may be few and their claims many, so that a shuffle by
    dataset would put most claims into a few tasks.
    """
    empty = F.array().cast("array<double>")
    arrays_of = fact_arrays(typed, dataset)
    joined = claims.join(F.broadcast(arrays_of) if send else arrays_of, dataset, "left")
    arrays = [F.coalesce(c, empty) for c in ("ints", "floats", "shares")]
    bad = F.filter("numbers", lambda x: ~near_enough(x, *[neighbours(a, x, max(most, 1)) for a in arrays], tolerance))
    return once(joined, F.struct(bad.alias("ungrounded"))).drop("ints", "floats", "shares")


def _bad_by_sort(
    claims: DataFrame, typed: DataFrame, dataset: str, tolerance: float, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``ungrounded`` by merging distinct numbers and facts in sorted ranges.

    Used when a dataset has too many facts for an array.  Ranges are about equal in size;
    facts of neighbouring ranges are carried over by a table of one row per range.
    """
    keyed = claims.withColumn("_claim", F.monotonically_increasing_id())
    keyed = checkpoint_cut(keyed)  # the ids must not change between the two uses
    numbers = keyed.select("_claim", dataset, F.explode("numbers").alias("x"))
    rows = typed.unionByName(numbers.select(dataset, F.lit("claim").alias("kind"), "x").distinct())
    cuts = order_ranges(rows, "x", range_rows)
    rows = rows.withColumn("_range", range_no(F.col("x"), cuts))
    kinds = ("int", "float", "share")

    def of(kind):
        return F.when(F.col("kind") == kind, F.col("x"))

    edges = rows.groupBy(dataset, "_range").agg(
        *[F.max(of(k)).alias(f"hi_{k}") for k in kinds], *[F.min(of(k)).alias(f"lo_{k}") for k in kinds]
    )
    w = Window.partitionBy(dataset).orderBy("_range")  # one row per range and dataset
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    carry = edges.select(
        dataset, "_range",
        *[F.last(f"hi_{k}", ignorenulls=True).over(before).alias(f"pre_{k}") for k in kinds],
        *[F.first(f"lo_{k}", ignorenulls=True).over(after).alias(f"post_{k}") for k in kinds],
    )
    inside = Window.partitionBy(dataset, "_range").orderBy("x")
    upto, onward = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(0, Window.unboundedFollowing)
    near = rows.withColumns({
        **{f"b_{k}": F.max(of(k)).over(upto) for k in kinds}, **{f"a_{k}": F.min(of(k)).over(onward) for k in kinds},
    }).where("kind = 'claim'").join(carry, [dataset, "_range"])
    sides = [F.array_compact(F.array(F.coalesce(f"b_{k}", f"pre_{k}"), F.coalesce(f"a_{k}", f"post_{k}"))) for k in kinds]
    verdict = near.select(dataset, "x", near_enough(F.col("x"), *sides, tolerance).alias("ok"))
    bad = numbers.join(verdict, [dataset, "x"]).where("not ok").groupBy("_claim").agg(F.collect_list("x").alias("_bad"))
    empty = F.array().cast("array<double>")
    return keyed.join(bad, "_claim", "left").withColumn(
        # keep the order (and repeats) in which the claim states its numbers
        "ungrounded", F.filter("numbers", lambda x: F.array_contains(F.coalesce("_bad", empty), x))
    ).drop("_claim", "_bad")


def ground_claims(
    claims: DataFrame, facts: DataFrame, text: str = "text", dataset: str = "dataset_id", tolerance: float = 0.05,
    few_facts: int = FEW_FACTS,
) -> DataFrame:
    """Add ``numbers``, ``ungrounded``, ``is_grounded`` and ``reason`` to each claim.

    A claim needs at least one number and every number must be grounded.
    """
    typed = typed_facts(facts, dataset)
    most, total = (n or 0 for n in typed.groupBy(dataset).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first())
    empty = F.array().cast("array<double>")
    numbered = once(claims, F.struct(F.coalesce(numbers_in(q(text)), empty).alias("numbers")))
    if most <= few_facts:
        judged = _bad_by_arrays(numbered, typed, dataset, tolerance, most, total <= SENT_FACTS)
    else:
        judged = _bad_by_sort(numbered, typed, dataset, tolerance)
    blank = F.coalesce(F.trim(q(text)) == "", F.lit(True))
    listed = F.concat_ws(", ", F.col("ungrounded").cast("array<string>"))
    return (
        judged.withColumn("is_grounded", ~blank & (F.size("numbers") > 0) & (F.size("ungrounded") == 0))
        .withColumn(
            "reason",
            F.when(blank, V.SAYS["empty_text"])
            .when(F.size("numbers") == 0, V.SAYS["no_numbers"])
            .when(F.size("ungrounded") > 0, F.concat(F.lit(V.SAYS["ungrounded"]), listed, F.lit("]")))
            .otherwise(""),
        )
    )


CONTRACT = "category string, text string, confidence string, evidence string, recommendation string"


def contract_reason(c: Column) -> Column:
    """First broken rule of the claim contract, '' where it holds.  ``c`` is a struct."""
    def text(name):
        return F.coalesce(F.trim(c[name]) != "", F.lit(False))

    conf = c["confidence"].try_cast("double")
    category = F.lower(F.trim(c["category"]))
    return (
        F.when(~text("category"), V.SAYS["no_category"])
        .when(~category.isin(V.CLAIM_CATEGORIES), "Invalid 'category'")
        .when(~text("text"), V.SAYS["no_text"])
        .when(conf.isNull() | F.isnan(conf), "Invalid 'confidence' value")
        .when((conf < 0.0) | (conf > 1.0), "Out-of-range 'confidence' value")
        .when(~text("evidence"), V.SAYS["no_evidence"])
        .when(~text("recommendation"), V.SAYS["no_recommendation"])
        .otherwise("")
    )


def check_contract(claims: DataFrame) -> DataFrame:
    """Add ``contract_reason`` to a claims table that has the contract columns."""
    have = set(claims.columns)
    fields = [F.col(n).cast("string").alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in ("category", "text", "confidence", "evidence", "recommendation")]
    return claims.withColumn("_c", F.struct(*fields)).withColumn("contract_reason", contract_reason(F.col("_c"))).drop("_c")


def parse_claims(raw: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Claims from JSON text: an array of objects, possibly wrapped in other text.

    Elements are first read as raw JSON, so that a quoted confidence (text, not a number)
    can be told from a numeric one; quoted ones and flags become NULL.
    """
    body = F.regexp_extract(q(column), r"(?s)(\[.*\])", 1)
    items = raw.select(*[q(k) for k in keep], F.posexplode(F.from_json(body, "array<string>")).alias("place", "_j"))
    names = ("category", "text", "confidence", "evidence", "recommendation")
    c = F.from_json("_j", CONTRACT)
    quoted = F.col("_j").rlike(r'"confidence"\s*:\s*"')
    return items.withColumn("_c", c).select(
        *[q(k) for k in keep],
        "place",
        *[F.when(~quoted, F.col("_c")[n]).alias(n) if n == "confidence" else F.col("_c")[n].alias(n) for n in names],
    )


def screen_claims(claims: DataFrame, facts: DataFrame, dataset: str = "dataset_id", tolerance: float = 0.05) -> DataFrame:
    """Contract first, grounding second: add ``accepted`` and the first rejection reason."""
    judged = ground_claims(check_contract(claims), facts, "text", dataset, tolerance)
    return judged.withColumn("accepted", (F.col("contract_reason") == "") & F.col("is_grounded")).withColumn(
        "rejection", F.when(F.col("contract_reason") != "", F.col("contract_reason")).otherwise(F.col("reason"))
    )
