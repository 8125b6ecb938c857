"""Masking of tables and texts, leak scans, message screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwise.functions.exprs import as_text, mask_text, q, redact_secrets, screen_message
from tabwise.operators.grams import SENT_BYTES, count_inside
from tabwise.operators.profile import ROW_ID

FEW_VALUES = 64  # value lists up to this size are tested one by one inside the projection


def mask_columns(df: DataFrame, columns: list[str] | dict[str, str]) -> DataFrame:
    """Replace whole columns by their redaction mark; also valid on a stream."""
    kinds = columns if isinstance(columns, dict) else {c: "PII" for c in columns}
    return df.withColumns({c: F.lit(f"[REDACTED_{k.upper()}]") for c, k in kinds.items() if c in df.columns})


def mask_texts(df: DataFrame, column: str, out: str = "masked") -> DataFrame:
    return df.withColumn(out, mask_text(q(column)))


def redact_log_lines(df: DataFrame, column: str, out: str = "line") -> DataFrame:
    return df.withColumn(out, redact_secrets(q(column)))


def masked_samples(df: DataFrame, column: str, n: int = 10, pii_type: str | None = None, row_id: str = ROW_ID) -> DataFrame:
    """First ``n`` non-blank values, masked (a top-n over the row id)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    v = as_text(column, types[column])
    rows = df.select(q(row_id).alias(row_id), v.alias("v")).where("v is not null and trim(v) <> ''")
    return rows.orderBy(row_id).limit(n).select(row_id, mask_text(F.col("v"), pii_type).alias("sample"))


def masked_preview(df: DataFrame, pii: dict[str, str], n: int = 5, row_id: str = ROW_ID) -> DataFrame:
    """First ``n`` rows with personal columns redacted."""
    return mask_columns(df.orderBy(q(row_id)).limit(n), pii)


def screen_messages(df: DataFrame, column: str) -> DataFrame:
    """Add ``screened``: the screening family a message falls into, else NULL."""
    return df.withColumn("screened", screen_message(q(column)))


def leak_scan(texts: DataFrame, text_id: str, text: str, values: DataFrame, value: str, few: int = FEW_VALUES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(text_id, leaked): number of distinct listed values that occur inside each text.

    Values shorter than three characters are ignored.  A short list is tested inside the projection.  A long one is
    filed under the substring of each value that the fewest texts hold; filters of bounded size drop all other places
    of the texts, and a text is tested for the values whose rare substring it holds.  Rows are told apart by an id of
    their own, so ``text_id`` may repeat.
    """
    listed = values.select(F.trim(q(value).cast("string")).alias("v")).where(F.length("v") >= 3).distinct()
    head = [r[0] for r in listed.limit(few + 1).collect()]
    if len(head) <= few:
        hits = sum((F.when(F.contains(q(text), F.lit(v)), 1).otherwise(0) for v in head), F.lit(0))
        return texts.select(q(text_id).alias(text_id), F.coalesce(hits, F.lit(0)).cast("long").alias("leaked"))
    found = count_inside(texts.select(q(text_id), q(text)), listed, sent_bytes)
    return found.toDF(text_id, "leaked")


def leak_summary(scan: DataFrame) -> DataFrame:
    """(texts, texts_with_leaks, leaked_values)."""
    return scan.agg(
        F.count("*").alias("texts"), F.count_if(F.col("leaked") > 0).alias("texts_with_leaks"),
        F.coalesce(F.sum("leaked"), F.lit(0)).alias("leaked_values"),
    )

