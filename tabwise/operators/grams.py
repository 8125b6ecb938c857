"""Which of many listed strings occur inside texts, by rare substrings and bounded filters.

Substrings of three to eight bytes are told by a rolling hash, taken over whole blocks of texts at
once.  A filter of bounded size, sent to every task, drops the positions of a text that meet no listed
string before anything is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwise.operators.sieve import BITS
from tabwise.session import checkpoint_cut, ship

SHORTEST, LONGEST = 3, 8
#: Bytes of text that are hashed at a time; a longer text is alone.
BLOCK = 2_000_000
#: Bytes of listed strings that are sent to every task; longer lists are met by a join.
SENT_BYTES = 32_000_000
#: A substring in more than SLICES / HOT of the texts is hot: of a text's L bytes at most 6 L can be, so hot ones are few.
HOT, SLICES = 1_000, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def rolling(raw: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the substring that starts at every place), for sizes in rising order."""
    h = np.zeros(len(raw), np.uint64)
    for k in range(1, sizes[-1] + 1):
        if len(raw) < k:
            return
        h = h[:len(raw) - k + 1] * _ODD + raw[k - 1:].astype(np.uint64)
        if k in sizes:
            g = (h + np.uint64(k)) * _MIX
            yield k, g ^ (g >> np.uint64(29))


def string_grams(value: bytes) -> np.ndarray:
    """Hashes of a listed string's substrings of the longest size, or of itself if it is shorter."""
    found = [g for _, g in rolling(np.frombuffer(value, np.uint8), [min(len(value), LONGEST)])]
    return np.unique(found[0])


def size_of(value: bytes) -> int:
    return min(len(value), LONGEST)


class Filter:
    """Bits of the hashes that matter; its size depends on their number up to a bound."""

    def __init__(self, hashes: DataFrame, sizes: list[int], count: int):
        bits = 1 << min(BITS.bit_length() - 1, max(16, (64 * count).bit_length()))
        at = F.pmod(F.col("h"), F.lit(bits))
        rows = hashes.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set_bits")).toArrow()
        self.words = np.zeros(bits // 64, np.uint64)  # BITS / 64 numbers at most
        self.words[rows.column("word").to_numpy()] = rows.column("set_bits").to_numpy().view(np.uint64)
        self.mask, self.sizes = np.uint64(bits - 1), sizes

    def passing(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, hashes) of the substrings that may matter, size by size."""
        for _, g in rolling(raw, self.sizes):
            at = g & self.mask
            hit = np.flatnonzero(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            yield hit, g[hit]


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """(first row, texts, bytes of all of them, text number of every place); a byte that no text holds parts them."""
    texts = [t.encode() if t is not None else b"" for t in batch.column(column).to_pylist()]
    first = size = 0
    for k, t in enumerate([*texts, b""]):
        size += len(t) + 1
        if k == len(texts) or size > BLOCK and k > first:
            part = texts[first:k]
            if part:
                yield first, part, np.frombuffer(b"\xff".join(part), np.uint8), np.cumsum([0] + [len(t) + 1 for t in part])
            first, size = k, len(t) + 1


def hits(filter_: Filter, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) pairs that pass a filter."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, g in filter_.passing(raw):
        places.append(np.searchsorted(starts, at, "right") - 1)
        hashes.append(g)
    text, h = np.concatenate(places), np.concatenate(hashes)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], h[new]


def anchors(listed: DataFrame, texts: DataFrame) -> tuple[DataFrame, Filter | None, int]:
    """(v, h) of the listed strings that may occur, each under its substring that the fewest texts hold; filter; bytes.

    A string with a substring that no text holds occurs nowhere and is left out.
    """
    spark = listed.sparkSession
    ship(spark)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.column(0).to_pylist():
                g = string_grams(v.encode())
                for at in range(0, len(g), 50_000):
                    part = g[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(part)), pa.array(part.view(np.int64)), pa.array(np.full(len(part), size_of(v.encode()), np.int32))], ["v", "h", "size"])

    own = checkpoint_cut(listed.mapInArrow(grams, "v string, h long, size int"))
    facts = own.agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.approx_count_distinct("h").alias("n")).first()
    if not facts.sizes:
        return own.select("v", "h"), None, 0
    sent = spark.sparkContext.broadcast(Filter(own, facts.sizes, facts.n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, starts in blocks(batch, 0):
                h, n = np.unique(hits(sent.value, raw, starts)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    often = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rare = own.join(often, "h", "left").groupBy("v").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("m"))
    found = checkpoint_cut(rare.where("m.n > 0").select("v", "m.h", F.least(F.octet_length("v"), F.lit(LONGEST)).alias("size")))
    size = found.agg(F.sum(F.octet_length("v") + 50).alias("bytes"), F.array_sort(F.collect_set("size")).alias("sizes"), F.count("*").alias("n")).first()
    return found.select("v", "h"), Filter(found, size.sizes, size.n) if size.n else None, size.bytes or 0


def count_inside(rows: DataFrame, listed: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``rows`` (id, text) as (id, n): how many distinct listed strings ``v`` (three characters or more) occur in each text.

    A list of proven size is sent to the tasks, which test a text for the strings whose rare substring it holds; nothing is
    shuffled.  A longer list is joined on the substrings' hashes.  Rows stay apart whatever their id.
    """
    spark = rows.sparkSession
    numbered = checkpoint_cut(rows.toDF("id", "text").withColumn("tid", F.monotonically_increasing_id()))
    found, filter_, size = anchors(listed, numbered.select("text"))
    if filter_ is None:
        return numbered.select("id", F.lit(0).cast("long").alias("n"))
    sent = spark.sparkContext.broadcast(filter_)
    if size <= sent_bytes:
        by_hash: dict[int, list[bytes]] = {}
        for v, h in zip(*(c.to_pylist() for c in found.toArrow().columns)):
            by_hash.setdefault(h & 0xFFFFFFFFFFFFFFFF, []).append(v.encode())
        held = spark.sparkContext.broadcast(by_hash)

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                counts = np.zeros(batch.num_rows, np.int64)
                for first, texts, raw, starts in blocks(batch, 1):
                    for k, h in zip(*(x.tolist() for x in hits(sent.value, raw, starts))):
                        for v in known.get(h, ()):
                            if v in texts[k]:
                                counts[first + k] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["id", "n"])

        out = numbered.select("id", "text")
        return out.mapInArrow(test, out.schema.simpleString()[7:-1].replace("text:string", "n:long"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, raw, starts in blocks(batch, 1):
                k, h = hits(sent.value, raw, starts)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + k]), pa.array(h.view(np.int64))], ["tid", "h"])

    named = numbered.select("tid", "text").mapInArrow(name, "tid long, h long")
    # a hash that many texts hold is dealt to several tasks, its strings to each of them
    every = named.groupBy("h").agg(F.count("*").alias("k"))
    hot = F.broadcast(checkpoint_cut(every.where(F.col("k") > F.lit(numbered.count() / HOT * SLICES))).select("h", F.lit(SLICES).alias("slices")))
    slices = F.coalesce("slices", F.lit(1))
    left = named.join(hot, "h", "left").withColumn("slice", F.pmod("tid", slices).cast("int"))
    right = found.join(hot, "h", "left").select("v", "h", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    pairs = left.join(right, ["h", "slice"]).select("tid", "v")
    held_in = pairs.join(numbered.select("tid", "text"), "tid").where(F.contains("text", "v")).groupBy("tid").agg(F.count_distinct("v").alias("n"))
    return numbered.select("id", "tid").join(held_in, "tid", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
