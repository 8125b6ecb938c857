"""Reversible cleaning: duplicates, types, dates, missing values, outlier flags.

Decisions (replacement values, bounds) are facts of one row per column and are read by
the driver; everything that grows with the data stays in DataFrames.  What was changed is
kept in sidecar tables, so ``reconstruct`` can restore the input exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tabwise.functions import fixed as V
from tabwise.functions.exprs import (
    as_double, is_blank, is_numeric, normalize_category, parse_bool, q, sample_skewness, share, strip_number,
)
from tabwise.operators.dates import normalize_date
from tabwise.operators.profile import ROW_ID, data_columns
from tabwise.operators.quantiles import exact_quantiles
from tabwise.operators.sieve import passing, sieve, stopped
from tabwise.session import checkpoint_cut, local_table

UNTOUCHED_LABELS = ["identifier", "email", "phone", "person_name", "credit_card", "ssn_national_id"]

LOG_SCHEMA = (
    "step_no int, column string, missing_count long, missing_pct double, method string, reason string, "
    "replacement_value string, reversible boolean, warning boolean, details map<string,double>"
)


def _log(step, column, method, reason, replacement=None, missing=0, pct=0.0, warning=False, details=None) -> Row:
    return Row(
        step_no=step, column=column, missing_count=missing, missing_pct=pct, method=method, reason=reason,
        replacement_value=None if replacement is None else str(replacement), reversible=True, warning=warning,
        details=details,
    )


# --- duplicates ---------------------------------------------------------------

def drop_duplicates(df: DataFrame, columns: list[str] | None = None, row_id: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the copy with the smallest row id stays.

    The kept table is a plain aggregation (min row id per distinct row): copies are
    folded in every task before the shuffle, so one row repeated a billion times costs
    one record per task.  Removed rows are found by row id, which has no hot keys.
    """
    columns = columns or [c for c in df.columns if c != row_id]
    rest = [c for c in df.columns if c not in columns and c != row_id]
    aggs = [F.min(q(row_id)).alias(row_id)]
    if rest:  # a key of some columns: the others come from the row that stays
        aggs.append(F.min_by(F.struct(*[q(c) for c in rest]), q(row_id)).alias("_rest"))
    first = df.groupBy(*[q(c) for c in columns]).agg(*aggs)
    kept = first.select(*[F.col("_rest")[c].alias(c) if c in rest else q(c) for c in df.columns])
    return kept, removed_rows(df, kept, row_id)


def removed_rows(df: DataFrame, kept: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Rows of ``df`` that are not in ``kept``, with their original index."""
    gone = df.join(kept.select(q(row_id)), row_id, "left_anti").select(*[q(c) for c in df.columns])
    return gone.withColumn("_orig_row_index", q(row_id))


def row_digests(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(digest, n): how many rows have a digest of all values; mergeable by summing ``n``."""
    return df.select(_digest(df, row_id).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def _digest(df: DataFrame, row_id: str) -> Column:
    return F.xxhash64(*[q(c) for c in df.columns if c != row_id])


def split_copies(df: DataFrame, row_id: str = ROW_ID, digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) as ``drop_duplicates`` over all columns, moving only rows whose digest occurs again.

    ``digests`` are the merged ``row_digests`` of the table where they are known.  A filter of bounded size lets rows
    with a digest of their own pass where they are; the others are compared by their values.
    """
    digests = row_digests(df, row_id) if digests is None else digests
    again = checkpoint_cut(sieve(digests.where("n > 1").select("digest"), "digest"))
    suspects = checkpoint_cut(passing(df, _digest(df, row_id), again))
    first = drop_duplicates(suspects, row_id=row_id)[0]
    kept = stopped(df, _digest(df, row_id), again).unionByName(first.select(*[q(c) for c in df.columns]))
    return kept, removed_rows(suspects, first, row_id)


# --- types ----------------------------------------------------------------------

def coerce_column(c: Column, dt: T.DataType, logical: str) -> Column:
    """Value of a column under its logical type; what does not parse becomes NULL."""
    text = isinstance(dt, T.StringType)
    if logical in ("int", "float"):
        d = strip_number(c) if text else c
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            d = F.when(~F.isnan(c), c)
        if logical == "int":
            return d.try_cast("bigint")
        return d.try_cast("double")
    if logical == "bool":
        return c if isinstance(dt, T.BooleanType) else parse_bool(c)
    if logical == "category":
        return normalize_category(c)
    return c


def coerce_types(df: DataFrame, profile: list[Row]) -> tuple[DataFrame, list[Row]]:
    """Coerce every column to its logical type in one projection.

    Identifiers and personal data are left alone.  A column whose numbers carry fractions
    next to whole ones stays a double.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    known = {r["name"]: r for r in profile}
    out, logs = [], []
    for c in df.columns:
        r = known.get(c)
        skip = r is None or r["is_pii"] or r["semantic_label"] in UNTOUCHED_LABELS
        if skip or r["dtype_inferred"] not in ("int", "float", "bool", "category"):
            out.append(q(c))
            continue
        out.append(coerce_column(q(c), types[c], r["dtype_inferred"]).alias(c))
        reason = f"coerced raw dtype '{types[c].simpleString()}' to inferred type '{r['dtype_inferred']}'"
        logs.append(_log(2, c, "type_coercion", reason, r["dtype_inferred"]))
    return df.select(*out), logs


# --- dates ----------------------------------------------------------------------

def normalize_dates(df: DataFrame, dates: list[Row]) -> tuple[DataFrame, list[Row]]:
    """ISO text for resolved date columns; ambiguous ones pass with a warning."""
    n = None
    logs = []
    present = [d for d in dates if d["column"] in df.columns]
    if not present:
        return df, []
    formats = {d["column"]: "ambiguous" if d["needs_confirmation"] else d["detected_format"] for d in present}
    text = {c for c, t in df.dtypes if t == "string"}
    out = df.select(
        *[normalize_date(q(c), formats[c]).alias(c) if c in formats and c in text else q(c) for c in df.columns]
    )
    row = df.agg(F.count("*").alias("n"), *[F.count(q(c)).alias(f"f{i}") for i, c in enumerate(formats)]).first()
    n = row["n"]
    for i, (c, fmt) in enumerate(formats.items()):
        missing = n - row[f"f{i}"]
        pct = round(missing / n * 100.0, 2) if n else 0.0
        if fmt == "ambiguous":
            logs.append(_log(
                3, c, "preserve_ambiguous_date",
                V.SAYS["ambiguous_date"],
                None, missing, pct, warning=True,
            ))
        else:
            logs.append(_log(
                3, c, "normalize_date", V.SAYS["date_normalized"].format(fmt),
                "YYYY-MM-DD", missing, pct,
            ))
    return out, logs


# --- missing values -----------------------------------------------------------

def numeric_fill_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Replacement value per numeric column that has gaps, with the reason behind it."""
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = as_double(c, types[c])
        aggs += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.min(x).alias(f"lo{i}"),
            sample_skewness(x, F.count(x)).alias(f"s{i}"),
            F.coalesce(F.bool_and(F.abs(x) % 1 == 0), F.lit(True)).alias(f"w{i}"),
        ]
    row = df.agg(*aggs).first()
    gaps = [(i, c) for i, c in enumerate(columns) if row[f"n{i}"] < row["n"]]
    skewed = [c for i, c in gaps if row[f"n{i}"] and abs(row[f"s{i}"]) > 1.0]
    medians = exact_quantiles(df, skewed, [0.5]) if skewed else {}
    facts = {}
    for i, c in gaps:
        n, filled, skew, whole = row["n"], row[f"n{i}"], row[f"s{i}"], row[f"w{i}"]
        missing = n - filled
        f = {"missing": missing, "pct": round(missing / n * 100.0, 2), "skew": skew, "whole": bool(whole and filled)}
        if not filled:
            f.update(method="constant", value=0.0, reason=V.SAYS["all_missing"])
        elif c in medians:
            f.update(
                method="median", value=medians[c][0],
                reason=V.SAYS["median_chosen"].format(skew),
            )
        else:
            f.update(
                method="mean", value=row[f"m{i}"], reason=V.SAYS["mean_chosen"].format(skew)
            )
        if filled and whole:
            f["value"] = float(round(f["value"]))
        if filled and row[f"lo{i}"] >= 0 and f["value"] < 0:
            f["value"] = 0.0
        facts[c] = f
    return facts


def category_fill_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Replacement value per text or flag column that has gaps: mode or 'Unknown'.

    The mode is the smallest of the most frequent values; counting is one aggregation over
    the unpivoted columns with partial sums before the shuffle.
    """
    if not columns:
        return {}
    blanks = df.agg(F.count("*").alias("n"), *[F.count_if(is_blank(q(c))).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    gaps = {c: blanks[f"b{i}"] for i, c in enumerate(columns) if blanks[f"b{i}"] > 0}
    n = blanks["n"]
    want = [c for c, b in gaps.items() if round(b / n * 100.0, 2) <= 30.0]
    modes = {}
    if want:
        filled = df.select(*[F.when(~is_blank(q(c)), q(c).cast("string")).alias(c) for c in want])
        # Largest count first, then the smallest value: two bounded aggregations.
        counts = (
            filled.unpivot([], [q(c) for c in want], "column", "value").where("value is not null")
            .groupBy("column", "value").agg(F.count("*").alias("k"))
        )
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("value"))).getField("value").alias("mode"))
        modes = {r["column"]: r["mode"] for r in best.collect()}
    facts = {}
    for c, b in gaps.items():
        pct = round(b / n * 100.0, 2)
        if pct <= 30.0 and c in modes:
            facts[c] = {
                "missing": b, "pct": pct, "method": "mode", "value": modes[c],
                "reason": V.SAYS["mode_used"].format(pct, modes[c]),
            }
        else:
            facts[c] = {
                "missing": b, "pct": pct, "method": "constant_unknown", "value": "Unknown",
                "reason": V.SAYS["unknown_used"].format(pct),
            }
    return facts


def split_columns(df: DataFrame, profile: list[Row], dates: list[Row]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns for imputation; dates belong to neither."""
    kinds = {r["name"]: r["dtype_inferred"] for r in profile}
    skip = {d["column"] for d in dates} | {c for c, k in kinds.items() if k == "date"}
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric, other = [], []
    for c in data_columns(df):
        if c in skip or isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType, T.StructType)):
            continue
        (numeric if is_numeric(types[c]) else other).append(c)
    return numeric, other


def impute(
    df: DataFrame, profile: list[Row], dates: list[Row], row_id: str = ROW_ID
) -> tuple[DataFrame, DataFrame, list[Row]]:
    """(filled table, null_cells sidecar, log).  Dates are never filled.

    ``null_cells(column, _row_id, raw)`` lists every filled cell with its raw content
    (blank text is not the same as NULL), as a table: it can be as long as the data.
    """
    numeric, other = split_columns(df, profile, dates)
    nums, cats = numeric_fill_facts(df, numeric), category_fill_facts(df, other)
    types = {f.name: f.dataType for f in df.schema.fields}
    out, cells, logs = [], [], []
    for c in df.columns:
        if c in nums:
            f = nums[c]
            gap = as_double(c, types[c]).isNull()
            out.append(F.when(gap, F.lit(f["value"]).cast(types[c])).otherwise(q(c)).alias(c))
        elif c in cats:
            f = cats[c]
            gap = is_blank(q(c))
            text = isinstance(types[c], T.StringType)
            value = F.lit(f["value"]) if text or f["value"] == "Unknown" else F.lit(f["value"]).cast(types[c])
            out.append(F.when(gap, value).otherwise(q(c) if text or f["value"] != "Unknown" else q(c).cast("string")).alias(c))
        else:
            out.append(q(c))
            continue
        logs.append(_log(4, c, f["method"], f["reason"], f["value"], f["missing"], f["pct"]))
        cells.append(F.when(gap, F.struct(F.lit(c).alias("column"), q(row_id).alias(row_id), q(c).cast("string").alias("raw"))))
    schema = f"column string, {row_id} bigint, raw string"
    if cells:
        sidecar = df.select(F.explode(F.filter(F.array(*cells), lambda e: e.isNotNull())).alias("e")).select("e.*")
    else:
        sidecar = local_table(df.sparkSession, [], schema)
    return df.select(*out), sidecar, logs


# --- outliers ---------------------------------------------------------------------

def outlier_bounds(df: DataFrame, columns: list[str], small_rows: int | None = None) -> dict[str, dict]:
    """q1, q3, iqr and the 1.5 IQR bounds per column; columns without spread are left out."""
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    extra = {} if small_rows is None else {"small_rows": small_rows}
    quart = exact_quantiles(df, columns, [0.25, 0.75], **extra)
    n = df.agg(*[F.count(as_double(c, types[c])).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    bounds = {}
    for i, c in enumerate(columns):
        q1, q3 = quart[c]
        if n[i] < 4 or q1 is None or q3 - q1 == 0.0:
            continue
        bounds[c] = {
            "q1": q1, "q3": q3, "iqr": q3 - q1, "lower": q1 - 1.5 * (q3 - q1), "upper": q3 + 1.5 * (q3 - q1), "n": n[i]
        }
    return bounds


def outlier_cells(df: DataFrame, bounds: dict[str, dict], row_id: str = ROW_ID) -> DataFrame:
    """(column, _row_id, value) of every value outside its bounds; nothing is modified."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if not bounds:
        return local_table(df.sparkSession, [], f"column string, {row_id} bigint, value double")
    cells = []
    for c, b in bounds.items():
        x = as_double(c, types[c])
        cells.append(F.when(
            (x < F.lit(b["lower"])) | (x > F.lit(b["upper"])),
            F.struct(F.lit(c).alias("column"), q(row_id).alias(row_id), x.alias("value")),
        ))
    return df.select(F.explode(F.filter(F.array(*cells), lambda e: e.isNotNull())).alias("e")).select("e.*")


def outlier_summary(df: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """(column, q1, q3, iqr, lower_bound, upper_bound, outlier_count, outlier_pct) where any."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(bounds)
    if not names:
        return local_table(df.sparkSession, 
            [], "column string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double, "
            "outlier_count long, outlier_pct double",
        )
    wide = df.agg(*[
        F.count_if((as_double(c, types[c]) < F.lit(bounds[c]["lower"])) | (as_double(c, types[c]) > F.lit(bounds[c]["upper"]))).alias(f"k{i}")
        for i, c in enumerate(names)
    ])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            *[F.round(F.lit(float(bounds[c][k])), 4).alias(a) for k, a in (
                ("q1", "q1"), ("q3", "q3"), ("iqr", "iqr"), ("lower", "lower_bound"), ("upper", "upper_bound"))],
            F.col(f"k{i}").alias("outlier_count"),
            F.round(F.col(f"k{i}") / F.lit(bounds[c]["n"]) * 100.0, 2).alias("outlier_pct"),
        )
        for i, c in enumerate(names)
    ])
    return wide.select(F.inline(rows)).where("outlier_count > 0")


def outlier_columns(df: DataFrame, profile: list[Row]) -> list[str]:
    """Numeric columns only: flags, dates, text and categories are never scanned."""
    kinds = {r["name"]: r["dtype_inferred"] for r in profile}
    types = {f.name: f.dataType for f in df.schema.fields}
    return [
        c for c in data_columns(df)
        if is_numeric(types[c]) and kinds.get(c, "float") not in ("bool", "date", "string", "category")
    ]


# --- the whole step ---------------------------------------------------------------

@dataclass
class Cleaned:
    """Cleaned table, sidecars and log of one cleaning run."""

    table: DataFrame
    removed: DataFrame
    null_cells: DataFrame
    raw_cells: DataFrame
    outliers: DataFrame
    log: DataFrame
    log_rows: list[Row] = field(default_factory=list)


RAW = "_raw_row"  # the untouched values of a row, carried next to the cleaned ones


def raw_sidecar(both: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(column, _row_id, raw): raw text of every kept cell whose value changed.

    Covers coerced numbers, flags, trimmed categories, normalised dates and filled gaps,
    so the round trip needs nothing but the cleaned table and the sidecars.  ``both``
    carries the raw values in ``RAW``: comparing them is one projection, no join.
    """
    cells = [
        F.when(
            ~F.col(RAW)[f.name].eqNullSafe(q(f.name).try_cast(f.dataType)),
            F.struct(F.lit(f.name).alias("column"), q(row_id).alias(row_id), F.col(RAW)[f.name].cast("string").alias("raw")),
        )
        for f in both.schema[RAW].dataType.fields
    ]
    return both.select(F.explode(F.filter(F.array(*cells), lambda e: e.isNotNull())).alias("e")).select("e.*")


def reconstruct(cleaned: DataFrame, removed: DataFrame, raw_cells: DataFrame, schema: T.StructType, row_id: str = ROW_ID) -> DataFrame:
    """The original table again, from cleaned rows, removed rows and changed cells."""
    names = [f.name for f in schema.fields if f.name != row_id]
    changed = raw_cells.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("column", "raw"))).alias("_raw"))
    restored = cleaned.join(changed, row_id, "left").select(
        q(row_id),
        *[
            F.when(F.coalesce(F.map_contains_key("_raw", c), F.lit(False)), F.col("_raw")[c].try_cast(schema[c].dataType))
            .otherwise(q(c).try_cast(schema[c].dataType)).alias(c)
            for c in names
        ],
    )
    back = removed.select(q(row_id), *[q(c) for c in names])
    return restored.unionByName(back).select(*[q(f.name) for f in schema.fields])


def clean(df: DataFrame, profile: DataFrame, dates: DataFrame, row_id: str = ROW_ID, digests: DataFrame | None = None) -> Cleaned:
    """Run all cleaning steps in order: duplicates, types, dates, gaps, outlier flags.

    ``df`` must carry a stable row id.  The de-duplicated table feeds several aggregations
    and is staged once.  ``digests`` are its merged ``row_digests`` where they are known.
    """
    spark = df.sparkSession
    prof, ds = profile.collect(), dates.collect()  # one row per column
    kept, removed = split_copies(df, row_id, digests)
    kept = checkpoint_cut(kept)
    n_removed = removed.count()
    total = kept.count() + n_removed
    logs: list[Row] = []
    if n_removed:
        logs.append(_log(
            1, "ALL_COLUMNS", "drop_duplicates", V.SAYS["copies_removed"].format(n_removed), None, 0, 0.0,
            details={"duplicate_count": float(n_removed), "duplicate_pct": round(n_removed / total * 100.0, 2)},
        ))
    names = [c for c in kept.columns if c != row_id]
    typed, type_logs = coerce_types(kept.withColumn(RAW, F.struct(*[q(c) for c in names])), prof)
    dated, date_logs = normalize_dates(typed, ds)
    both, null_cells, fill_logs = impute(dated, prof, ds, row_id)
    filled = both.drop(RAW)
    bounds = outlier_bounds(filled, outlier_columns(filled, prof))
    flagged = outlier_summary(filled, bounds).collect()
    out_logs = [
        _log(
            5, r["column"], "flag_outliers_iqr",
            V.SAYS["outliers_flagged"].format(r['lower_bound'], r['upper_bound']),
            details={k: float(r[k]) for k in ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_pct")},
        )
        for r in flagged
    ]
    logs += type_logs + date_logs + fill_logs + out_logs
    return Cleaned(
        table=filled,
        removed=removed,
        null_cells=null_cells,
        raw_cells=raw_sidecar(both, row_id),
        outliers=outlier_cells(filled, bounds, row_id),
        log=local_table(spark, logs, LOG_SCHEMA) if logs else local_table(spark, [], LOG_SCHEMA),
        log_rows=logs,
    )


def before_after(before: DataFrame, cleaned: Cleaned) -> DataFrame:
    """One row: sizes before and after plus an order-free fingerprint of the result."""
    a = before.agg(F.count("*").alias("rows_before"))
    b = fingerprint(cleaned.table).withColumnRenamed("n_rows", "rows_after")
    return a.join(b, how="cross").select(
        "rows_before", "rows_after", F.lit(len(data_columns(before))).alias("cols_before"),
        F.lit(len(data_columns(cleaned.table))).alias("cols_after"),
        (F.col("rows_before") - F.col("rows_after")).alias("duplicates_removed"), "content_sum",
    )


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, content_sum): equal for equal row multisets in any order or partitioning."""
    columns = columns or data_columns(df)
    h = F.xxhash64(*[q(c) for c in columns]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("content_sum"))


def missing_share(df: DataFrame) -> DataFrame:
    """(column, completeness) of every column, one aggregation."""
    names = data_columns(df)
    wide = df.agg(F.count("*").alias("n"), *[F.count(q(c)).alias(f"f{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.round(share(F.col(f"f{i}"), F.col("n"), 100.0), 1).alias("completeness"))
        for i, c in enumerate(names)
    ])))
