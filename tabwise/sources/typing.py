"""Physical types of freshly read text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwise.functions.exprs import q


def to_physical_types(df: DataFrame) -> DataFrame:
    """Long, double or boolean where every filled value of a text column parses as such."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return df
    aggs = []
    for i, c in enumerate(text):
        t = F.trim(q(c))
        whole = t.rlike(r"^[+-]?\d{1,18}$")
        number = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        flag = t.isin("True", "False", "TRUE", "FALSE", "true", "false")
        aggs += [F.bool_and(whole).alias(f"w{i}"), F.bool_and(number).alias(f"n{i}"), F.bool_and(flag).alias(f"f{i}")]
    row = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        if c not in text:
            out.append(q(c))
            continue
        i = text.index(c)
        t = F.trim(q(c))
        if row[f"w{i}"]:
            out.append(t.try_cast("bigint").alias(c))
        elif row[f"n{i}"]:
            out.append(t.try_cast("double").alias(c))
        elif row[f"f{i}"]:
            out.append(F.lower(t).try_cast("boolean").alias(c))
        else:
            out.append(q(c))
    return df.select(*out)
