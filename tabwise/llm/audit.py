"""Interaction of five quality filters: what each removes at every place of every order.

A to D look at a document alone.  E, a text that a smaller doc_id has too, is marked by a left-semi join
on the hash, the exact text and a smaller doc_id.  Its ids are united with those of the other failures
and aggregated to combinations of bits; all orders are counted from the few combinations.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, functions as F

from ..operators.sieve import passing, sieve
from ..session import local_table
from .common import map_rows, pick, stage

FILTERS = "ABCDE"
#: The conditions' numbers and characters.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
SYMBOLS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A text with more than one in so many of all rows is dealt to several tasks; there are at most as many such texts.
HOT = 1_000


def failures(text: str) -> int:
    """Bits of A to D; A is 1."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
            | (100 * capitals > CAPITAL_SHARE * len(text)) << 2 | (len(raw) != len(raw.translate(None, SYMBOLS))) << 3)


def copies_of_smaller(d: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, part, h1, h2) of ``d`` (with text) whose text a smaller doc_id has too.

    ``rows`` holds the hashes alone.  Texts move only where their hash occurs under two ids, as far as a filter of
    bounded size can tell; of equal texts one row a task moves to name the smallest id, and a text that very many
    rows have is dealt to several tasks.
    """
    several = stage(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high"), "audit-copies")
    every = rows.count()
    # at most HOT rows: each stands for more than every / HOT rows
    hot = several.groupBy("h1").agg(F.sum("n").alias("n")).filter(F.col("n") > F.lit(every / HOT))
    hot = F.broadcast(hot.select("h1", F.ceil(F.col("n") * HOT / F.lit(max(1, every))).cast("int").alias("slices")))
    near = passing(d, F.col("h1"), sieve(several, "h1"))
    slices = F.coalesce("slices", F.lit(1))
    left = near.join(hot, "h1", "left").withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices).cast("int"))
    first = near.groupBy("h1", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    right = first.join(hot, "h1", "left").select("h1", "text", "first", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id"))
    return a.join(b, same, "left_semi").select("doc_id", "part", "h1", "h2")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): documents of a source by the combination of filters they fail, and those labelled."""
    d = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "part").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("part", F.lit("")).alias("part"))
    d = d.withColumn("h1", F.xxhash64(F.lit(1), "text")).withColumn("h2", F.xxhash64(F.lit(2), "text"))
    judged = map_rows(d, lambda: lambda doc, text, part, h1, h2: ((doc, part, h1, h2, failures(text)),), "doc_id long, part string, h1 long, h2 long, bits int")
    rows = stage(judged, "audit-rows")
    again = copies_of_smaller(d, rows).select("*", F.lit(1 << 4).alias("bits"), F.lit(0).cast("long").alias("n"))
    # a key's rows are equal but for their source; the copies' ids add a bit and no row
    failed = rows.withColumn("n", F.lit(1).cast("long")).unionByName(again).groupBy("doc_id", "h1", "h2", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    few = failed.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    known = pick(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    few = few.join(known, "doc_id", "left")
    return few.groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"))


def orders() -> list[tuple]:
    """For every combination of bits, order and step: what one document of it counts as."""
    out = []
    for bits in range(1 << len(FILTERS)):
        for order in permutations(range(len(FILTERS))):
            name, before = "".join(FILTERS[f] for f in order), 0
            for step, f in enumerate(order, 1):
                fails, reached = bits >> f & 1, not bits & before
                share = 120 // bin(bits).count("1") if fails else 0  # of all orders, those in which this filter comes first of its failures
                out.append((bits, name, step, int(reached and not fails), int(reached and fails), int(fails and not reached), int(bits == 1 << f), share))
                before |= 1 << f
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per source (``part``), order of the filters and step, with long counts of documents.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  Null texts are empty, null sources the empty
    string.  A row with a null doc_id is no copy and makes none; equal rows with one doc_id are no copies of each other.
    Repeated labels count by their largest values; rows without a label are neither good nor toxic.  Empty documents
    give an empty table; other columns are not looked at.
    """
    counted = combinations(docs, labels, **columns)
    plan = local_table(docs.sparkSession, orders(), "bits int, filter_order string, step int, keeps int, removes int, repeats int, only int, share int")
    every = counted.join(F.broadcast(plan), "bits")  # 19,200 rows whatever the data

    def total(count: str, flag: str):
        return F.sum(F.col(count) * F.col(flag)).cast("long")

    return every.groupBy("part", "filter_order", "step").agg(
        total("n", "keeps").alias("kept"), total("n", "removes").alias("removed"), total("n", "repeats").alias("redundant"), total("n", "only").alias("unique_fails"),
        total("good", "removes").alias("good_lost"), total("toxic", "removes").alias("toxic_lost"), total("n", "share").alias("shapley"))
