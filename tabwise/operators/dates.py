"""Date format resolution and normalisation.

All date columns are judged in one scan of the shared value counts; only the tiers that
borrow from other columns look at the (tiny) per-column result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabwise.functions import fixed as V
from tabwise.functions.exprs import q, share
from tabwise.operators.profile import ROW_ID, data_columns, first_values, value_counts
from tabwise.session import local_table


def date_evidence(counts: DataFrame) -> DataFrame:
    """(column, filled, matched, all_iso, day_first, day_second, sep) per column."""
    v = F.trim(F.col("value"))
    n = F.col("n")

    def part(k):
        return F.regexp_extract(v, V.DATE_PARTS, k)

    parts = counts.where("value is not null").select(
        "column", "n", "first_row",
        v.rlike(V.DATE_PARTS).alias("hit"),
        part(1).try_cast("int").alias("p1"), part(2).alias("sep"), part(3).try_cast("int").alias("p2"),
    )
    hit = F.col("hit")
    return parts.groupBy("column").agg(
        F.sum("n").alias("filled"),
        F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("matched"),
        F.bool_and(F.when(hit, F.col("p1") >= 1000)).alias("all_iso"),
        F.coalesce(F.bool_or(F.when(hit, (F.col("p1") > 12) & (F.col("p2") <= 12))), F.lit(False)).alias("day_first"),
        F.coalesce(F.bool_or(F.when(hit, (F.col("p2") > 12) & (F.col("p1") <= 12))), F.lit(False)).alias("day_second"),
        # Separator of the first matching row; by value where rows carry no id.
        F.min(F.when(hit, F.struct(F.coalesce("first_row", F.lit(0)), F.col("sep")))).getField("sep").alias("sep"),
    )


def locale_format(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """At most one row (locale_column, locale_value, locale_format): the first known
    locale among the first ten values of a country-like column."""
    spark = df.sparkSession
    named = [c for c in data_columns(df) if c.lower() in V.LOCALE_HEADERS]
    empty = "locale_column string, locale_value string, locale_format string"
    if not named or row_id not in df.columns:
        return local_table(spark, [], empty)
    known = local_table(spark, list(V.LOCALE_FORMATS.items()), "locale_value string, locale_format string")
    place = F.create_map(*[x for i, c in enumerate(named) for x in (F.lit(c), F.lit(i))])
    lead = first_values(df, 10, named, row_id).withColumn("locale_value", F.lower("value"))
    return (
        lead.join(F.broadcast(known), "locale_value")
        .orderBy(place[F.col("column")], "first_row")
        .limit(1)
        .select(F.col("column").alias("locale_column"), "locale_value", "locale_format")
    )


def resolve_dates(
    df: DataFrame, columns: list[str] | None = None, counts: DataFrame | None = None,
    sample_rows: bool = False, row_id: str = ROW_ID,
) -> DataFrame:
    """One row per date column: format, confidence, evidence, needs_confirmation.

    Tiers: native dates and four-digit-year-first; a day above 12; the format of an
    earlier resolved column; the format of a known locale; otherwise ambiguous.
    """
    columns = columns or data_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    native = [c for c in columns if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    text = [c for c in columns if isinstance(types[c], T.StringType)]
    spark = df.sparkSession
    place = local_table(spark, [(c, i) for i, c in enumerate(columns)], "column string, ordinal int")
    if text:
        if sample_rows:
            counts = first_values(df, V.SAMPLE_DATE_ROWS, text, row_id)
        elif counts is None:
            counts = value_counts(df, text, row_id)
        seen = date_evidence(counts.where(F.col("column").isin(text)))
    else:
        seen = date_evidence(local_table(spark, [], "column string, value string, n long, first_row long"))
    seen = seen.where((F.col("matched") > 0) & (share(F.col("matched"), F.col("filled")) >= 0.60))
    s = F.col("sep")
    own = (
        F.when(F.col("all_iso"), F.concat(F.lit("YYYY"), s, F.lit("MM"), s, F.lit("DD")))
        .when(F.col("day_first") & ~F.col("day_second"), F.concat(F.lit("DD"), s, F.lit("MM"), s, F.lit("YYYY")))
        .when(F.col("day_second") & ~F.col("day_first"), F.concat(F.lit("MM"), s, F.lit("DD"), s, F.lit("YYYY")))
    )
    why = (
        F.when(F.col("all_iso"), "four-digit year in first position")
        .when(F.col("day_first") & ~F.col("day_second"), "day value > 12 found in first position")
        .when(F.col("day_second") & ~F.col("day_first"), "day value > 12 found in second position")
    )
    found = seen.select("column", own.alias("own"), why.alias("why"))
    if native:
        filled = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(native)]).select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(native)]))
        )
        found = found.unionByName(
            filled.where("n > 0").select("column", F.lit("YYYY-MM-DD").alias("own"), F.lit("native datetime dtype").alias("why"))
        )
    known = found.join(F.broadcast(place), "column").join(
        F.broadcast(locale_format(df, row_id)), F.lit(True), "left"
    )
    # A column counts as resolved for later ones by its own tiers or by the locale.
    fmt = F.coalesce("own", "locale_format")
    w = Window.partitionBy(F.lit(1)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn(
        "lender", F.first(F.when(fmt.isNotNull(), F.struct(fmt.alias("fmt"), F.col("column"))), ignorenulls=True).over(w)
    )
    tier = (
        F.when(F.col("own").isNotNull(), 1).when(F.col("lender").isNotNull(), 2)
        .when(F.col("locale_format").isNotNull(), 3).otherwise(4)
    )
    return (
        known.withColumn("tier", tier)
        .select(
            "ordinal",
            "column",
            F.coalesce("own", F.col("lender.fmt"), "locale_format", F.lit("ambiguous")).alias("detected_format"),
            F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.75).when(F.col("tier") == 3, 0.70)
            .otherwise(0.50).alias("confidence"),
            F.when(F.col("tier") == 1, F.col("why"))
            .when(F.col("tier") == 2, F.format_string("matched format of resolved column '%s'", F.col("lender.column")))
            .when(F.col("tier") == 3, F.format_string("inferred from country/locale column '%s' value '%s'", "locale_column", "locale_value"))
            .otherwise("all day and month components <= 12; no disambiguating signal").alias("evidence"),
            (F.col("tier") == 4).alias("needs_confirmation"),
        )
    )


def spark_pattern(detected_format: str) -> str:
    """Spark date pattern of a detected format; odd separators fall back by first part."""
    known = V.DATE_PATTERNS.get(detected_format)
    if known:
        return known
    if detected_format.startswith("DD"):
        return "d/M/yyyy"
    return "M/d/yyyy" if detected_format.startswith("MM") else "yyyy-M-d"


def normalize_date(c: Column, detected_format: str) -> Column:
    """ISO text of a resolved date; text that does not parse stays as it is.

    Ambiguous formats pass through unchanged: a date is never guessed.
    """
    if detected_format == "ambiguous":
        return c
    text = c.cast("string")
    return F.coalesce(F.date_format(F.try_to_date(text, spark_pattern(detected_format)), "yyyy-MM-dd"), text)
