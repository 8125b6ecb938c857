"""Summary statistics and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from tabwise.functions.exprs import (
    as_double, as_text, is_numeric, q, safe_corr, sample_kurtosis, sample_skewness, share,
)
from tabwise.operators.comoments import correlations
from tabwise.operators.profile import data_columns
from tabwise.operators.quantiles import SMALL_ROWS, attach_ranks, exact_quantiles, keyed_ranks
from tabwise.session import checkpoint_cut, local_table

FEW_COLUMNS = 10  # whose pairs are one aggregation
HOT = 1_000  # a value with more than one in so many of all entries is joined by broadcast
BATCH = 200  # expressions per aggregation, so that generated code stays within JVM method limits


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name in data_columns(df)]


def _batches(items: list, per_item: int) -> list[list]:
    size = max(1, BATCH // per_item)
    return [items[i : i + size] for i in range(0, len(items), size)]


NUMERIC_SUMMARY = (
    "column", "count", "null_count", "null_pct", "mean", "std", "min", "q25", "median", "q75", "max",
    "iqr", "skewness", "kurtosis",
)


def numeric_summary(df: DataFrame, columns: list[str] | None = None, small_rows: int = SMALL_ROWS) -> DataFrame:
    """One row per numeric column, four decimals.

    Moments of all columns come from one aggregation without any shuffle of rows; the
    quartiles come from ``exact_quantiles``.  Undefined skewness and kurtosis are 0.
    """
    columns = numeric_columns(df) if columns is None else columns
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = "column string, " + ", ".join(
        f"{c} {'long' if c in ('count', 'null_count') else 'double'}" for c in NUMERIC_SUMMARY[1:]
    )
    if not columns:
        return local_table(df.sparkSession, [], schema)
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75], small_rows)
    out = None
    for batch in _batches(columns, 8):
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(batch):
            x = as_double(c, types[c])
            n = F.count(x)
            aggs += [
                n.alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"sd{i}"), F.min(x).alias(f"lo{i}"),
                F.max(x).alias(f"hi{i}"), sample_skewness(x, n).alias(f"sk{i}"), sample_kurtosis(x, n).alias(f"ku{i}"),
            ]
        rows = []
        for i, c in enumerate(batch):
            n = F.col(f"n{i}")
            qs = [F.lit(v).cast("double") for v in quart[c]]

            def r4(e, some=n):
                return F.when(some > 0, F.round(e, 4))

            rows.append(F.struct(
                F.lit(c).alias("column"), n.alias("count"), (F.col("rows") - n).alias("null_count"),
                F.round(share(F.col("rows") - n, F.col("rows"), 100.0), 2).alias("null_pct"),
                r4(F.col(f"m{i}")).alias("mean"), r4(F.coalesce(F.col(f"sd{i}"), F.lit(0.0))).alias("std"),
                r4(F.col(f"lo{i}")).alias("min"), r4(qs[0]).alias("q25"), r4(qs[1]).alias("median"),
                r4(qs[2]).alias("q75"), r4(F.col(f"hi{i}")).alias("max"), r4(qs[2] - qs[0]).alias("iqr"),
                r4(F.col(f"sk{i}")).alias("skewness"), r4(F.col(f"ku{i}")).alias("kurtosis"),
            ))
        part = df.agg(*aggs).select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out


def categorical_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over trimmed, non-blank text; the shared input of E02-like views."""
    types = {f.name: f.dataType for f in df.schema.fields}
    trimmed = df.select(*[F.trim(as_text(c, types[c])).alias(c) for c in columns])
    return (
        trimmed.unpivot([], [q(c) for c in columns], "column", "value")
        .where("value is not null and value <> ''")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """(column, place, value, n): the k most frequent values, ties by value.

    ``row_number <= k`` is pushed below the shuffle as a window group limit.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("column", "place", "value", "n")


def categorical_summary(df: DataFrame, columns: list[str], sensitive: list[str] = ()) -> DataFrame:
    """One row per column: filled, distinct, null count/pct, top value and the top five.

    Values of sensitive columns (personal data, identifiers) are never shown.
    """
    if not columns:
        return local_table(df.sparkSession, 
            [], "column string, count long, unique_count long, null_count long, null_pct double, "
            "top_category string, top_category_freq long, top_categories array<struct<value:string,n:long>>",
        )
    counts = categorical_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique_count"))
    shown = top_values(counts.where(~F.col("column").isin(list(sensitive))) if sensitive else counts)
    tops = shown.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("t")  # five entries at most
    ).select(
        "column", F.get("t", F.lit(0)).getField("value").alias("top_category"), F.get("t", F.lit(0)).getField("n").alias("top_category_freq"),
        F.transform("t", lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"))).alias("top_categories"),
    )
    nulls = df.agg(F.count("*").alias("rows"), *[F.count(q(c)).alias(f"f{i}") for i, c in enumerate(columns)]).select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"f{i}")).alias("null_count"),
                     F.round(share(F.col("rows") - F.col(f"f{i}"), F.col("rows"), 100.0), 2).alias("null_pct"))
            for i, c in enumerate(columns)
        ]))
    )
    # One row per column on every side from here on.
    return nulls.join(totals, "column", "left").join(tops, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "null_count", "null_pct", "top_category", "top_category_freq", "top_categories",
    )


def sensitive_names(profile: list[Row]) -> list[str]:
    return [r["name"] for r in profile if r["is_pii"] or r["semantic_label"] == "identifier"]


def dataset_summary(df: DataFrame, profile: list[Row]) -> tuple[DataFrame, DataFrame]:
    """(numeric facts, categorical facts) of a whole table."""
    numeric = numeric_columns(df)
    other = [c for c in data_columns(df) if c not in numeric]
    return numeric_summary(df, numeric), categorical_summary(df, other, sensitive_names(profile))


# --- correlations -----------------------------------------------------------------

def eligible_numeric(df: DataFrame, profile: list[Row] = ()) -> list[str]:
    """Numeric columns that may be correlated or charted: not sensitive and not constant."""
    hidden = set(sensitive_names(profile))
    names = [c for c in numeric_columns(df) if c not in hidden]
    if not names:
        return []
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*[
        F.coalesce((F.count(as_double(c, types[c])) > 1) & (F.min(as_double(c, types[c])) < F.max(as_double(c, types[c]))), F.lit(False)).alias(f"v{i}")
        for i, c in enumerate(names)
    ]).first()
    return [c for i, c in enumerate(names) if row[f"v{i}"]]


def _pair_agg(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    names = list(exprs)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    out = None
    for batch in _batches(pairs, 4):
        wide = df.agg(*[safe_corr(exprs[names[i]], exprs[names[j]]).alias(f"r{i}_{j}") for i, j in batch])
        part = wide.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(names[i]).alias("col1"), F.lit(names[j]).alias("col2"),
                     F.col(f"r{i}_{j}").alias("r"))
            for i, j in batch
        ])))
        out = part if out is None else out.unionByName(part)
    return out


PAIRS = "i int, j int, col1 string, col2 string, r double"


def _placed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """PAIRS from (i, j, r) with numbers of columns."""
    name = F.array(*[F.lit(c) for c in columns])
    return rows.select("i", "j", F.get(name, F.col("i")).alias("col1"), F.get(name, F.col("j")).alias("col2"), "r")


def pearson_pairs(df: DataFrame, columns: list[str], few: int = FEW_COLUMNS) -> DataFrame:
    """(i, j, col1, col2, r) for every pair i < j, pairwise complete, one pass, no row shuffle.

    The pairs of few columns are one aggregation; of more columns every task adds up one matrix of products.
    """
    if len(columns) < 2:
        return local_table(df.sparkSession, [], PAIRS)
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(columns) <= few:
        return _pair_agg(df, {c: as_double(c, types[c]) for c in columns})
    found = correlations(df.select(*[as_double(c, types[c]).alias(c) for c in columns]))
    # a pair without a common row has no sums
    every = local_table(df.sparkSession, [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))], "i int, j int")
    return _placed(every.join(found, ["i", "j"], "left"), columns)


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, col1, col2, r) of average ranks.

    Complete columns share one ranking each.  A pair with gaps is ranked over its complete rows; its ranks are
    those of a column among the rows where a pattern of gaps is filled, and all pairs with that pattern share them.
    """
    if len(columns) < 2:
        return local_table(df.sparkSession, [], PAIRS)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = df.select(*[as_double(c, types[c]).alias(c) for c in columns])
    row = num.agg(F.count("*").alias("n"), *[F.count(q(c)).alias(f"f{i}") for i, c in enumerate(columns)]).first()
    full = [i for i, c in enumerate(columns) if row[f"f{i}"] == row["n"]]
    parts = []
    if len(full) > 1:
        names = [columns[i] for i in full]
        ranked = attach_ranks(num.select(*[q(c) for c in names]), names)
        at = F.array(*[F.lit(i) for i in full])
        parts.append(_pair_agg(ranked, {c: q("rank_" + c) for c in names}).select(F.get(at, F.col("i")).alias("i"), F.get(at, F.col("j")).alias("j"), "r"))
    if len(full) < len(columns):
        parts.append(_gappy_spearman(num, columns, full))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _placed(out, columns)


def gap_patterns(num: DataFrame, columns: list[str]) -> list[int]:
    """For every column the number of its pattern of gaps: columns that are null in the same rows share one."""
    h = F.xxhash64("_at").cast("decimal(38,0)")
    rows = num.withColumn("_at", F.monotonically_increasing_id())
    sums = rows.agg(*[F.struct(F.count(F.when(q(c).isNull(), 1)).alias("n"), F.sum(F.when(q(c).isNull(), h)).alias("h")).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    seen: dict = {}
    return [seen.setdefault((p["n"], p["h"]), len(seen)) for p in sums]


def _gappy_spearman(num: DataFrame, columns: list[str], full: list[int]) -> DataFrame:
    """(i, j, r) of all pairs with a column that has gaps: one ranking of (column, pattern) entries, one matrix of products."""
    staged = checkpoint_cut(num.withColumn("_at", F.monotonically_increasing_id()))
    pattern = gap_patterns(staged.drop("_at"), columns)
    mask = {}  # a column that stands for its pattern
    for i, p in enumerate(pattern):
        mask.setdefault(p, i)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns)) if not (i in full and j in full)]
    keys: dict[tuple[int, int], int] = {}
    for i, j in pairs:
        keys.setdefault((i, pattern[j]), len(keys))
        keys.setdefault((j, pattern[i]), len(keys))
    entry = F.array(*[
        F.struct(F.lit(k).alias("key"), F.when(q(columns[mask[p]]).isNotNull(), q(columns[i])).alias("value")) for (i, p), k in keys.items()
    ])
    entries = staged.select("_at", F.inline(entry)).where("value is not null")
    ranks = checkpoint_cut(keyed_ranks(entries))
    # values that many rows share are joined by broadcast: at most one in HOT of all entries each
    limit = max(1.0, ranks.agg(F.sum("n")).first()[0] / HOT)
    hot = F.broadcast(ranks.where(F.col("n") >= limit).select("key", "value", F.col("rank").alias("_hot")))  # HOT rows at most
    met = entries.join(hot, ["key", "value"], "left")
    served = met.where("_hot is not null").select("_at", "key", F.col("_hot").alias("rank"))
    rest = met.where("_hot is null").join(ranks.where(F.col("n") < limit), ["key", "value"]).select("_at", "key", "rank")
    wide = served.unionByName(rest).groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("key", "rank"))).alias("m"))  # one entry a key
    found = correlations(wide.select(*[F.col("m")[k].alias(f"k{k}") for k in keys.values()]))
    place = {}
    for i, j in pairs:
        a, b = keys[i, pattern[j]], keys[j, pattern[i]]
        place[i, j] = min(a, b), max(a, b)
    wanted = local_table(num.sparkSession, [(i, j, a, b) for (i, j), (a, b) in place.items()], "x int, y int, i int, j int")
    return wanted.join(found, ["i", "j"], "left").select(F.col("x").alias("i"), F.col("y").alias("j"), "r")


def top_pairs(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs by falling |r|; ties keep column order."""
    out = (
        pairs.where("r is not null")
        .select("i", "j", "col1", "col2", F.round("r", 4).alias("pearson_r"), F.round(F.abs("r"), 4).alias("abs_r"))
        .orderBy(F.desc("abs_r"), "i", "j")
    )
    return out if n is None else out.limit(n)


def correlation_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Long matrix (col1, col2, r) with both triangles and the diagonal, four decimals."""
    half = pairs.select("col1", "col2", F.round("r", 4).alias("r"))
    flipped = half.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")
    diagonal = local_table(pairs.sparkSession, [(c, c, 1.0) for c in columns], "col1 string, col2 string, r double")
    return half.unionByName(flipped).unionByName(diagonal)
