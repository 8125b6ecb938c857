"""Exact quantiles and ranks that never gather one column into one task.

Spark's exact ``percentile`` keeps a map of every distinct value of a group in one
aggregation buffer.  That is fine for a table of a million rows and fatal for one of
10^12, so the operators here only use it below a checked row count.  Above it they

1. read a small quantile sketch per column (a few thousand numbers, bounded by its
   accuracy, collected as facts),
2. count rows around the wanted positions in one map-side aggregation, do both again within the
   narrower bands until each holds few rows or one value, and
3. sort only those.

The sketches merely decide where to look: the answers are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwise.functions.exprs import as_double, count_at_most, q
from tabwise.session import checkpoint_cut

SMALL_ROWS = 500_000        # below this many rows the built-in exact percentile is used
SKETCH_ACCURACY = 20_000    # sketch error <= rows / accuracy
BAND_ROWS = 20_000          # rows of a band of values that one task sorts
MAX_ROUNDS = 40             # of narrowing; each divides a band's rows by about accuracy / 4
RANGE_ROWS = 2_000_000      # aimed size of one ordered range used for ranks and positions
MAX_RANGES = 16_384


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], small_rows: int = SMALL_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolated exact quantiles per column: {column: [value per prob]}."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num = df.select(*[as_double(c, types[c]).alias(c) for c in columns])
    if num.count() <= small_rows:
        row = num.agg(
            *[F.percentile(q(c), F.array(*[F.lit(p) for p in probs])).alias(f"c{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(columns)}
    return _banded_quantiles(num, columns, probs)


def _banded_quantiles(
    num: DataFrame, columns: list[str], probs: list[float], accuracy: int = SKETCH_ACCURACY, band_rows: int = BAND_ROWS
) -> dict[str, list[float | None]]:
    """Bands of values around every wanted position are narrowed until each holds few rows or a single value.

    A round is two aggregations over all columns at once: sketches of the open bands, then counts of the rows below and
    inside the narrower ones.  A band shrinks by about accuracy / 4 a round, so rounds grow with the logarithm of the
    table.  Only the last, small bands are sorted.
    """
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    near = {p: (max(0.0, p - 2.0 / accuracy), min(1.0, p + 2.0 / accuracy)) for p in probs}
    marks = sorted({m for pair in near.values() for m in pair})
    whole = num.agg(
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)], *[F.min(q(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(q(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(q(c), F.array(*[F.lit(m) for m in marks]), accuracy).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    bands = []
    for i, c in enumerate(columns):
        if whole[f"n{i}"]:
            at = dict(zip(marks, whole[f"s{i}"]))
            for j, p in enumerate(probs):
                b = _Band(i, j, p * (whole[f"n{i}"] - 1), 0, whole[f"n{i}"], whole[f"lo{i}"], whole[f"hi{i}"], 2.0 / accuracy)
                b.aim = (b.low if near[p][0] == 0.0 else at[near[p][0]], b.high if near[p][1] == 1.0 else at[near[p][1]])
                bands.append(b)
    opened = bands
    for _ in range(MAX_ROUNDS):
        if opened:
            _count(num, columns, opened)
        opened = [b for b in bands if b.found is None and b.n > band_rows]
        if not opened:
            break
        _sketch(num, columns, opened, accuracy)
    rest = [b for b in bands if b.found is None]
    if rest:
        # Only rows of the small bands travel; equal values are counted before the shuffle.
        entries = F.array(*[F.struct(F.lit(k).alias("band"), q(columns[b.column]).alias("v"), b.inside(columns).alias("inside")) for k, b in enumerate(rest)])
        counted = num.select(F.inline(entries)).where("inside").groupBy("band", "v").count()
        lists = counted.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("v", "count"))).alias("vs"))  # band_rows values at most
        places = ([math.floor(b.at) - b.below for b in rest], [math.ceil(b.at) - b.below for b in rest])
        for r in lists.select("band", _value_at("vs", places[0]).alias("lo"), _value_at("vs", places[1]).alias("hi")).collect():
            rest[r["band"]].found = r["lo"], r["hi"]
    for b in bands:
        lo, hi = b.found
        out[columns[b.column]][b.prob] = lo + (hi - lo) * (b.at - math.floor(b.at))
    return out


@dataclass
class _Band:
    """Values from ``low`` to ``high`` that hold position ``at`` of a column: ``below`` rows lie under them, ``n`` inside."""

    column: int
    prob: int
    at: float
    below: int
    n: int
    low: float
    high: float
    eps: float
    aim: tuple[float, float] | None = None  # narrower band to count next
    found: tuple[float, float] | None = None  # values at the places around the position

    def inside(self, columns: list[str]) -> Column:
        return q(columns[self.column]).between(F.lit(self.low), F.lit(self.high))

    def narrow(self, under: int, first: int, last: int, n: int, next_: float | None, before: float | None) -> None:
        """Take in what was counted of the aimed band: rows under it, at its ends and in it, and the values next to its ends."""
        lo, hi = self.aim
        f, c = math.floor(self.at) - self.below - under, math.ceil(self.at) - self.below - under
        if f < 0 or c >= n:
            self.eps *= 4  # the sketch was off by more than it promises
            return
        middle = n - first - last if lo < hi else 0

        def value(k: int) -> float | None:
            return lo if k < first else hi if k >= first + middle else None

        a, b = value(f), value(c)
        if a is None and b is None:
            self.below, self.n, self.low, self.high = self.below + under + first, middle, next_, before
        else:
            self.found = (before if a is None else a, next_ if b is None else b)


def _count(num: DataFrame, columns: list[str], bands: list[_Band]) -> None:
    """Count rows around the aimed bands, in one aggregation."""
    aggs = []
    for k, b in enumerate(bands):
        v = F.when(b.inside(columns), q(columns[b.column]))
        lo, hi = (F.lit(x) for x in b.aim)
        aggs += [F.count_if(v < lo), F.count_if(v == lo), F.count_if(v == hi), F.count_if(v.between(lo, hi)), F.min(F.when(v > lo, v)), F.max(F.when(v < hi, v))]
    row = num.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()
    for k, b in enumerate(bands):
        b.narrow(*row[6 * k:6 * k + 6])


def _sketch(num: DataFrame, columns: list[str], bands: list[_Band], accuracy: int) -> None:
    """Aim at narrower bands by a sketch of each open one; positions that share a band share its sketch."""
    spans: dict[tuple, set[float]] = {}
    for b in bands:
        place = (b.at - b.below) / max(b.n - 1, 1)
        b.aim = max(0.0, place - b.eps), min(1.0, place + b.eps)
        spans.setdefault((b.column, b.low, b.high), set()).update(b.aim)
    aggs = [
        F.percentile_approx(F.when(q(columns[i]).between(F.lit(lo), F.lit(hi)), q(columns[i])), F.array(*[F.lit(m) for m in sorted(wanted)]), accuracy).alias(f"s{k}")
        for k, ((i, lo, hi), wanted) in enumerate(spans.items())
    ]
    row = num.agg(*aggs).first()
    at = {span: dict(zip(sorted(wanted), row[k])) for k, (span, wanted) in enumerate(spans.items())}
    for b in bands:
        found = at[b.column, b.low, b.high]
        b.aim = (b.low if b.aim[0] == 0.0 else found[b.aim[0]], b.high if b.aim[1] == 1.0 else found[b.aim[1]])


def _value_at(counted: str, places: list[int]) -> Column:
    """The value at a 0-based place (by band) of a sorted array of values with counts."""
    place = F.get(F.array(*[F.lit(p) for p in places]), F.col("band"))
    step = F.aggregate(
        counted, F.struct(place.cast("long").alias("left"), F.lit(None).cast("double").alias("v")),
        lambda s, e: F.struct((s["left"] - e["count"]).alias("left"), F.when((s["left"] >= 0) & (s["left"] < e["count"]), e["v"]).otherwise(s["v"]).alias("v")),
    )
    return step["v"]


def doubles(values: list[float]) -> Column:
    """Array literal of many numbers, parsed in one call."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def order_ranges(df: DataFrame, order: str, range_rows: int = RANGE_ROWS) -> list[float]:
    """Cut points that split a numeric column into ranges of about ``range_rows`` rows.

    At most ``MAX_RANGES`` numbers come to the driver; a small table has no cuts at all.
    """
    n = df.count()
    parts = min(MAX_RANGES, math.ceil(n / range_rows))
    if parts <= 1:
        return []
    marks = doubles([k / parts for k in range(1, parts)])
    row = df.agg(F.percentile_approx(q(order), marks, parts * 10)).first()
    return sorted(set(row[0])) if row[0] is not None else []


def range_no(order: Column, cuts: list[float]) -> Column:
    """Number of the range a value falls into."""
    return count_at_most(doubles(cuts), order, F.lit(len(cuts)), len(cuts)) if cuts else F.lit(0)


def running_start(counts: DataFrame, order: str, n: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``start`` = sum of ``n`` over all rows with a smaller ``order`` value.

    ``order`` must be unique.  Rows are put into about equal ranges of ``order``; the
    totals of the ranges (at most ``MAX_RANGES`` rows) give each range its offset, and the
    running sum is taken inside the ranges in parallel.  The counts are staged once: they
    serve the cut points, the totals and the result.
    """
    counts = checkpoint_cut(counts)
    cuts = order_ranges(counts, order, range_rows)
    ranged = counts.withColumn("_range", range_no(q(order), cuts))
    totals = ranged.groupBy("_range").agg(F.sum(n).alias("_total"))
    offsets = totals.select(
        F.col("_range"),
        (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_offset"),
    )
    inside = F.sum(n).over(Window.partitionBy("_range").orderBy(q(order))) - q(n)
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn("start", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )


def average_ranks(df: DataFrame, column: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(value, n, rank): average rank of every distinct value, ties share their mean."""
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = (
        df.select(as_double(column, types[column]).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    return running_start(counts, "value", "n", range_rows).select(
        "value", "n", (F.col("start") + (F.col("n") + 1) / 2.0).alias("rank")
    )


def keyed_ranks(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, value, n, rank): average rank of every distinct value within its key, all keys in one pass.

    Every key's values are cut into about equal ranges; ranges of all keys are summed side by side, and the totals
    give each range its offset.
    """
    counts = checkpoint_cut(entries.groupBy("key", "value").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("key").agg(F.count("*").alias("m")).agg(F.count("*").alias("keys"), F.max("m").alias("m")).first()
    parts = max(1, min(MAX_RANGES // max(1, sizes["keys"]), math.ceil((sizes["m"] or 0) / range_rows)))
    if parts == 1:
        ranged = counts.withColumn("_range", F.lit(0))
    else:
        marks = doubles([k / parts for k in range(1, parts)])
        cuts = counts.groupBy("key").agg(F.percentile_approx("value", marks, parts * 10).alias("_cuts"))
        ranged = counts.join(F.broadcast(cuts), "key").withColumn("_range", count_at_most(F.col("_cuts"), F.col("value"), None, parts)).drop("_cuts")  # MAX_RANGES numbers
    totals = ranged.groupBy("key", "_range").agg(F.sum("n").alias("_total"))
    offsets = totals.select("key", "_range", (F.sum("_total").over(Window.partitionBy("key").orderBy("_range")) - F.col("_total")).alias("_offset"))
    upto = F.sum("n").over(Window.partitionBy("key", "_range").orderBy("value"))
    offsets = F.broadcast(offsets) if (sizes["keys"] or 0) * parts <= MAX_RANGES else offsets
    return ranged.withColumn("_upto", upto).join(offsets, ["key", "_range"]).select(
        "key", "value", "n", (F.col("_offset") + F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))


def attach_ranks(
    df: DataFrame, columns: list[str], prefix: str = "rank_", hot_share: float = 0.001, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Join the average rank of each column to its rows.

    A value that fills more than ``hot_share`` of the table would put all its rows into
    one join task.  There are at most 1/hot_share such values, so their ranks are
    broadcast and only the remaining values are joined by shuffle.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    limit = max(1.0, df.count() * hot_share)
    out = df
    for c in columns:
        ranks = average_ranks(df, c, range_rows)
        hot = ranks.where(F.col("n") >= limit).select(F.col("value").alias("_hv"), F.col("rank").alias("_hr"))
        cold = ranks.where(F.col("n") < limit).select(F.col("value").alias("_cv"), F.col("rank").alias("_cr"))
        key = as_double(c, types[c])
        out = out.withColumn("_k", key).join(F.broadcast(hot), F.col("_k") == F.col("_hv"), "left")
        # Rows already served (or without a value) get a spread of keys that match nothing.
        out = out.withColumn("_served", F.col("_hr").isNotNull() | F.col("_k").isNull()).withColumn(
            "_salt", F.when(F.col("_served"), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(-1))
        )
        out = (
            out.join(
                cold.withColumn("_csalt", F.lit(-1).cast("long")),
                (F.col("_k") == F.col("_cv")) & (F.col("_salt") == F.col("_csalt")),
                "left",
            )
            .withColumn(prefix + c, F.coalesce("_hr", "_cr"))
            .drop("_k", "_hv", "_hr", "_served", "_salt", "_cv", "_cr", "_csalt")
        )
    return out


def global_positions(
    df: DataFrame, order: str, row_id: str = "_row_id", chunk: int = 1_000_000, range_rows: int = RANGE_ROWS, every: int = 1
) -> DataFrame:
    """Add ``position``: 0-based place of each row in the order (``order``, ``row_id``).

    ``every=k`` keeps only positions 0, k, 2k, ...: the counts tell which blocks hold such a
    position, and only the rows of those few blocks (at most one per kept row) are moved.

    Rows are first counted per (order value, block of row ids); a single value that
    covers a third of the table is thereby cut into blocks of at most ``chunk`` rows.
    """
    dt = dict(df.dtypes)[order]
    key = q(order)
    if dt.startswith("timestamp"):
        key = F.unix_micros(key.cast("timestamp"))
    elif dt == "date":
        key = F.unix_date(key)
    exact = dt in ("double", "bigint", "int", "smallint", "tinyint") or dt.startswith(("timestamp", "date", "decimal"))
    rows = df.where(q(order).isNotNull()).withColumn("_o", key if exact else key.cast("double")).withColumn(
        "_block", F.floor(q(row_id) / F.lit(chunk))
    )
    counts = rows.groupBy("_o", "_block").agg(F.count("*").alias("n"))
    per_value = counts.groupBy("_o").agg(F.sum("n").alias("n"))
    starts = running_start(per_value, "_o", "n", range_rows).select("_o", "start")
    # The blocks of one value are few (rows / chunk), so a window per value is small.
    blocks = counts.join(starts, "_o").select(
        "_o",
        "_block",
        "n",
        (F.col("start") + F.sum("n").over(Window.partitionBy("_o").orderBy("_block")) - F.col("n")).alias("_from"),
    )
    if every > 1:
        last = F.col("_from") + F.col("n") - 1
        blocks = blocks.where(F.floor(last / every) * every >= F.col("_from"))
        blocks = F.broadcast(blocks)  # at most rows / every + 1 blocks, the size of the result
    blocks = blocks.drop("n")
    place = F.row_number().over(Window.partitionBy("_o", "_block").orderBy(q(row_id))) - 1
    placed = rows.join(blocks, ["_o", "_block"]).withColumn("position", (F.col("_from") + place).cast("long"))
    return placed.where(F.col("position") % every == 0).drop("_o", "_block", "_from")


def smallest_by_hash(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """Deterministic sample: the ``n`` rows with the smallest md5(seed:row_id).

    Only rows under a hash threshold compete for the final top-n, so that the last merge
    sees a small multiple of ``n`` rows instead of ``n`` rows from every task.  The
    threshold is raised until it holds at least ``n`` rows: the result is exact.
    """
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), q(row_id).cast("string"))))
    total = df.count()
    fraction = 4.0 * n / max(total, 1)
    pool = keyed
    while fraction < 1.0:
        limit = format(int(fraction * 2**60), "015x")
        pool = keyed.where(F.substring("_h", 1, 15) < limit)
        if pool.count() >= n:
            break
        fraction *= 4
        pool = keyed
    return pool.orderBy("_h", q(row_id)).limit(n).drop("_h")
