"""Chart plans and chart-ready aggregates; rendering is left to the caller.

Every function returns a small table whatever the size of the input: bins, groups of at
most fifteen categories, or a sample of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, functions as F

from tabwise.functions.exprs import as_double, as_text, q, share
from tabwise.operators.profile import ROW_ID, data_columns
from tabwise.operators.quantiles import exact_quantiles, global_positions, keyed_ranks, smallest_by_hash
from tabwise.operators.stats import eligible_numeric, numeric_columns, sensitive_names
from tabwise.session import checkpoint_cut, local_table

TREND_POINTS = 5_000
SCATTER_POINTS = 10_000
MAX_GROUPS = 15  # what a plan offers, and what becomes columns of one pass
KERNEL_REACH = 6  # bandwidths beyond which the kernel is left out


def chart_plan(
    df: DataFrame, profile: list[Row], dates: list[Row] = (), top: tuple[str, str] | None = None, max_charts: int = 6
) -> DataFrame:
    """(place, chart_type, x_col, y_col, columns) chosen by nine ordered rules.

    A rule adds its charts only while there is room: heatmap, trend, scatter, histograms,
    category bars, box plot, target distribution, completeness, violin.
    """
    hidden = set(sensitive_names(profile))
    by_name = {r["name"]: r for r in profile}
    names = [c for c in data_columns(df) if c not in hidden]
    numeric = eligible_numeric(df, profile)
    every_number = set(numeric_columns(df))
    times = [d["column"] for d in dates if d["column"] in df.columns and not d["needs_confirmation"]]
    groups = [
        c for c in names
        if c not in every_number and c not in times and 1 <= by_name[c]["unique_count"] <= MAX_GROUPS
    ]
    first_group = groups[0] if groups else None
    rules: list[list[tuple]] = [[] for _ in range(9)]
    if len(numeric) >= 3:
        rules[0] = [("correlation_heatmap", None, None, numeric)]
    if times and numeric:
        rules[1] = [("line_trend", times[0], numeric[0], None)]
    if len(numeric) >= 2:
        x, y = top if top else (numeric[0], numeric[1])
        rules[2] = [("scatter", x, y, None)]
    rules[3] = [("histogram", c, None, None) for c in numeric]
    rules[4] = [("categorical_bar", c, None, None) for c in groups]
    if numeric:
        rules[5] = [("boxplot", first_group, numeric[0], None)]
        rules[8] = [("violin", first_group, numeric[0], None)]
    targets = [r["name"] for r in profile if r["is_target_candidate"] and r["name"] in df.columns]
    if targets:
        rules[6] = [("target_distribution", None, targets[0], None)]
    if len(names) >= 2:
        rules[7] = [("data_completeness", None, None, names[:15])]
    plan = [p for rule in rules for p in rule][:max_charts]
    rows = [(i + 1, *p) for i, p in enumerate(plan)]
    return local_table(df.sparkSession, 
        rows, "place int, chart_type string, x_col string, y_col string, columns array<string>"
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) over equal-width bins of all rows."""
    types = {f.name: f.dataType for f in df.schema.fields}
    x = as_double(column, types[column])
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return local_table(df.sparkSession, [], "bin int, low double, high double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    no = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return (
        df.where(x.isNotNull()).select(no.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
                (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n")
    )


def trend(df: DataFrame, time: str, value: str, row_id: str = ROW_ID, points: int = TREND_POINTS) -> DataFrame:
    """(position, time, value): rows in time order, every k-th, k = rows // points (at least 1)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(q(row_id).alias(row_id), q(time).alias("time"), as_double(value, types[value]).alias("value")).where(
        "time is not null and value is not null"
    )
    step = max(1, rows.count() // points)
    return (
        global_positions(rows, "time", row_id, every=step)
        .select("position", row_id, "time", "value")
    )


def trend_by_period(df: DataFrame, time: str, value: str, period: str = "month") -> DataFrame:
    """(period, n, mean, total): the aggregated form of a trend, one partial-aggregated shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    x = as_double(value, types[value])
    return (
        df.where(q(time).isNotNull() & x.isNotNull())
        .groupBy(F.date_trunc(period, q(time)).alias("period"))
        .agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.sum(x).alias("total"))
    )


def scatter_sample(df: DataFrame, x: str, y: str, row_id: str = ROW_ID, points: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """(row id, x, y) of a repeatable sample of complete pairs."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(q(row_id).alias(row_id), as_double(x, types[x]).alias("x"), as_double(y, types[y]).alias("y")).where(
        "x is not null and y is not null"
    )
    return smallest_by_hash(rows, points, row_id, seed)


def category_frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) by falling count, ties by value."""
    types = {f.name: f.dataType for f in df.schema.fields}
    total = df.agg(F.count(q(column))).scalar()
    return (
        df.select(as_text(column, types[column]).alias("value")).where("value is not null")
        .groupBy("value").agg(F.count("*").alias("n"))
        .select("value", "n", F.round(share(F.col("n"), total, 100.0), 2).alias("pct"))
        .orderBy(F.desc("n"), "value")
    )


def box_plot(df: DataFrame, value: str, group: str | None = None, few: int = MAX_GROUPS) -> DataFrame:
    """(group, n, q1, median, q3, low_whisker, high_whisker, outliers) per group.

    Few groups become columns of one wide exact-quantile pass; the values of more groups are ranked side by side in
    ranges.  Either way no group is gathered in one task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    x = as_double(value, types[value])
    if group is None:
        keys: list = ["all"]
        wide = df.select(x.alias("g0"))
    else:
        g = as_text(group, types[group])
        keys = [r[0] for r in df.select(g.alias("g")).where("g is not null").distinct().limit(few + 1).collect()]
        if len(keys) > few:
            return _boxes_of_many(df.select(g.alias("key"), x.alias("value")).where("key is not null and value is not null"))
        keys.sort()
        wide = df.select(*[F.when(g == F.lit(k), x).alias(f"g{i}") for i, k in enumerate(keys)])
    cols = [f"g{i}" for i in range(len(keys))]
    quart = exact_quantiles(wide, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c in cols:
        q1, _, q3 = quart[c]
        lo, hi = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        inside = F.col(c).between(F.lit(lo), F.lit(hi))
        aggs += [
            F.count(c).alias("n" + c), F.min(F.when(inside, F.col(c))).alias("l" + c),
            F.max(F.when(inside, F.col(c))).alias("h" + c), F.count_if(~inside).alias("o" + c),
        ]
    return wide.agg(*aggs).select(F.inline(F.array(*[
        F.struct(
            F.lit(k).alias("group"), F.col("n" + c).alias("n"),
            *[F.lit(v).cast("double").alias(a) for v, a in zip(quart[c], ("q1", "median", "q3"))],
            F.col("l" + c).alias("low_whisker"), F.col("h" + c).alias("high_whisker"), F.col("o" + c).alias("outliers"),
        )
        for k, c in zip(keys, cols)
    ]))).where("n > 0")


def _boxes_of_many(entries: DataFrame) -> DataFrame:
    """``box_plot`` of (key, value) rows for any number of keys."""
    ranks = checkpoint_cut(keyed_ranks(entries))
    start = F.col("rank") - (F.col("n") + 1) / 2  # values before the first of this value
    total = ranks.groupBy("key").agg(F.sum("n").alias("total"))
    placed = ranks.join(total, "key").withColumn("start", start)
    aggs = []
    for i, p in enumerate((0.25, 0.5, 0.75)):
        at = (F.col("total") - 1) * F.lit(p)
        for j, place in enumerate((F.floor(at), F.ceil(at))):
            here = (F.col("start") <= place) & (place < F.col("start") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"v{i}{j}"))
    found = placed.groupBy("key", "total").agg(*aggs)
    between = [F.col(f"v{i}0") + (F.col(f"v{i}1") - F.col(f"v{i}0")) * ((F.col("total") - 1) * F.lit(p) - F.floor((F.col("total") - 1) * F.lit(p))) for i, p in enumerate((0.25, 0.5, 0.75))]
    quart = found.select("key", *[b.alias(a) for a, b in zip(("q1", "median", "q3"), between)])
    inside = F.col("value").between(F.expr("q1 - 1.5 * (q3 - q1)"), F.expr("q3 + 1.5 * (q3 - q1)"))
    return ranks.join(quart, "key").groupBy(F.col("key").alias("group"), "q1", "median", "q3").agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col("value"))).alias("low_whisker"), F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    ).select("group", "n", "q1", "median", "q3", "low_whisker", "high_whisker", "outliers")


def target_distribution(df: DataFrame, target: str, discrete: bool, bins: int = 30) -> DataFrame:
    """Counts of a discrete target (value, n, pct), else its histogram."""
    return category_frequency(df, target) if discrete else histogram(df, target, bins)


def completeness(df: DataFrame, profile: list[Row] = (), first: int = 15) -> DataFrame:
    """(ordinal, column, completeness %) of the first fifteen non-sensitive columns."""
    hidden = set(sensitive_names(profile))
    names = [c for c in data_columns(df) if c not in hidden][:first]
    wide = df.agg(F.count("*").alias("n"), *[F.count(q(c)).alias(f"f{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                 F.round(share(F.col(f"f{i}"), F.col("n"), 100.0), 1).alias("completeness"))
        for i, c in enumerate(names)
    ])))


def violin_density(df: DataFrame, value: str, group: str | None = None, bins: int = 40) -> DataFrame:
    """(group, bin, centre, n, density): histogram density per group over shared bins."""
    types = {f.name: f.dataType for f in df.schema.fields}
    x = as_double(value, types[value])
    g = F.lit("all") if group is None else as_text(group, types[group])
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return local_table(df.sparkSession, [], "group string, bin int, centre double, n long, density double")
    width = (hi - lo) / bins if hi > lo else 1.0
    no = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    cells = (
        df.where(x.isNotNull()).select(g.alias("group"), no.alias("bin")).where("group is not null")
        .groupBy("group", "bin").agg(F.count("*").alias("n"))
    )
    totals = cells.groupBy("group").agg(F.sum("n").alias("total"))
    return cells.join(totals, "group").select(
        "group", "bin", (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("centre"), "n",
        (F.col("n") / (F.col("total") * F.lit(width))).alias("density"),
    )


def violin(df: DataFrame, value: str, group: str | None = None, cells: int = 128, most_cells: int = 4_096) -> DataFrame:
    """(group, point, at, density, bandwidth, n, q1, median, q3, low_whisker, high_whisker, outliers) of every group.

    A Gaussian kernel density over all rows and the box beside it.  The bandwidth follows spread and size of the group
    (the smaller of standard deviation and scaled interquartile range); the grid reaches two bandwidths beyond the
    values, with at least four cells a bandwidth up to ``most_cells``.  Values are shared out between the two grid
    points around them, and the kernel is applied to the grid, so the work on rows does not grow with the grid.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    g = F.lit("all") if group is None else as_text(group, types[group])
    rows = df.select(g.alias("group"), as_double(value, types[value]).alias("x")).where("group is not null and x is not null")
    spread = rows.groupBy("group").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"))
    boxes = box_plot(df, value, group).join(spread, "group")
    narrow = F.when(F.expr("q3 > q1"), F.least("sd", F.expr("(q3 - q1) / 1.349"))).otherwise(F.col("sd"))
    h = F.when(F.col("sd") > 0, 1.059 * narrow * F.pow("n", F.lit(-0.2))).otherwise(1.0)
    shape = boxes.withColumn("h", h).withColumn("low", F.expr("lo - 2 * h")).withColumn("range", F.expr("hi - lo + 4 * h"))
    shape = shape.withColumn("cells", F.greatest(F.lit(cells), F.least(F.lit(most_cells), F.ceil(F.expr("range / (h / 4)"))).cast("int"))).withColumn("step", F.expr("range / cells"))
    shape = checkpoint_cut(shape)
    sent = F.broadcast if shape.count() <= 10_000 else lambda facts: facts  # one row a group
    at = F.expr("(x - low) / step")
    k = F.least(F.floor(at), F.col("cells") - 1).cast("int")
    shares = rows.join(sent(shape.select("group", "low", "step", "cells")), "group").select("group", F.inline(F.array(
        F.struct(k.alias("k"), (1 - (at - k)).alias("w")), F.struct((k + 1).alias("k"), (at - k).alias("w")))))
    grid = shares.groupBy("group", "k").agg(F.sum("w").alias("w"))
    near = grid.join(sent(shape.select("group", "h", "step", "cells")), "group").withColumn("reach", F.ceil(F.expr(f"{KERNEL_REACH} * h / step")))
    spreaded = near.select("group", "k", "w", "h", "step", F.explode(F.expr("sequence(greatest(0, k - int(reach)), least(cells, k + int(reach)))")).alias("point"))
    dense = spreaded.groupBy("group", "point").agg(F.sum(F.expr("w * exp(-0.5 * pow((point - k) * step / h, 2))")).alias("mass"))
    points = shape.select("*", F.explode(F.expr("sequence(0, cells)")).alias("point"))
    density = F.coalesce("mass", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return points.join(dense, ["group", "point"], "left").select(
        "group", "point", F.expr("low + point * step").alias("at"), density.alias("density"), F.col("h").alias("bandwidth"),
        "n", "q1", "median", "q3", "low_whisker", "high_whisker", "outliers",
    )
