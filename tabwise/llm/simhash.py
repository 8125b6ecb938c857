"""SimHash near-duplicates: pigeonhole blocks, a join on them, and a check of the Hamming distance.

A fingerprint's 64 bits are cut into six blocks.  Two fingerprints that differ in at most three bits
agree in at least three blocks, so every choice of three blocks is a key, and close pairs share one.
Equal fingerprints are one class from the start.  Within a key, links are found in numpy and handed
on as stars, so the links of a bucket grow with its members and not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import exact_names, map_rows, pick, stage
from .components import components

#: Bits in which linked fingerprints may differ.
DISTANCE = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Members of one key that a single task compares; a key with more goes through neighbour keys.
CROWD = 20_000
#: Members of one key that are compared pair by pair.
FEW = 16


def _masks() -> list[int]:
    blocks, at = [], 0
    for w in WIDTHS:
        blocks.append(((1 << w) - 1) << at)
        at += w
    return [sum(c) for c in combinations(blocks, len(WIDTHS) - DISTANCE)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashes of all three-word shingles; no word gives zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(t) for t in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[at:at + 65_536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed number) of every row."""
    def start():
        return lambda doc, text: ((doc, signed(fingerprint(text))),)

    return map_rows(pick(docs, id_col, text_col), start, "doc_id long, fp long")


def bucket_stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same members as all pairs within the distance do: (root, member)."""
    rest = np.unique(fps)
    links = []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= DISTANCE
            found = rest[near]
            if len(found):
                rest = rest[~near]
                queue.extend(found)
                links += [(int(root), int(x)) for x in found]
    return links


def _runs(crowd: int):
    """Links of each key in rows sorted by (combo, key); members of a crowded key are passed on as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, crowded = None, np.zeros(0, np.uint64), False

        def out(a: list[int], b: list[int], mask: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([mask] * len(a), pa.int64())], ["a", "b", "mask"])

        def close(fps: np.ndarray) -> list[tuple[int, int]]:
            return [(signed(x), signed(y)) for x, y in bucket_stars(fps)] if len(fps) > 1 else []

        for batch in batches:
            mask, fp = (np.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            if not len(mask):
                continue
            fp = fp.view(np.uint64)
            key = np.stack([mask, fp.view(np.int64) & mask], 1)
            edge = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(mask)]
            links: list[tuple[int, int]] = []
            # the first run goes on from the batch before, the last one may go on in the next
            for i in sorted({0, len(starts) - 1}):
                k = tuple(key[starts[i]])
                part = fp[starts[i]:ends[i]]
                if k != held_key:
                    if not crowded:
                        links += close(held)
                    held_key, held, crowded = k, part, False
                else:
                    held = part if crowded else np.concatenate([held, part])
                if crowded or len(held) > crowd:
                    crowded = True
                    if len(held):
                        yield out(held.view(np.int64).tolist(), held.view(np.int64).tolist(), int(k[0]))
                    held = np.zeros(0, np.uint64)
            length = ends - starts
            inner = np.arange(len(starts))[1:-1]
            for i in inner[length[1:-1] > FEW]:
                if length[i] > crowd:
                    own = fp[starts[i]:ends[i]].view(np.int64).tolist()
                    yield out(own, own, int(mask[starts[i]]))
                else:
                    links += close(fp[starts[i]:ends[i]])
            # short runs of the whole batch at once: each row against the d-th after it
            short = np.zeros(len(mask), bool)
            if len(inner):
                number = np.repeat(np.arange(len(starts)), length)
                ok = (length <= FEW) & (length > 1)
                ok[[0, -1]] = False
                short = ok[number]
                for d in range(1, FEW):
                    left = np.flatnonzero(short[:-d] & (number[:-d] == number[d:])) if d < len(mask) else []
                    if not len(left):
                        break
                    left = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= DISTANCE]
                    links += zip(fp[left].view(np.int64).tolist(), fp[left + d].view(np.int64).tolist())
            if links:
                yield out([x for x, _ in links], [y for _, y in links], None)
        if len(held) and not crowded and (links := close(held)):
            yield out([x for x, _ in links], [y for _, y in links], None)

    return run


def _through_neighbours(crowded: DataFrame) -> DataFrame:
    """Links of crowded keys without comparing members.

    Members that agree on the mask differ on the free bits only.  Two of them within three bits have a
    common neighbour at most one bit from one and two from the other: every member names all values
    within two free bits, and a value that some member is within one bit of ties together all that
    name it.  The rows grow with the members.
    """
    def start():
        cache: dict[int, list[int]] = {}

        def work(fp, mask):
            if mask not in cache:
                free = [1 << b for b in range(64) if not (mask & ((1 << 64) - 1)) >> b & 1]
                cache[mask] = [*free, *(x | y for x, y in combinations(free, 2))]
                cache[mask, 0] = len(free)
            singles, u = cache[mask, 0], fp & ((1 << 64) - 1)
            yield mask, fp, fp, True
            for i, flip in enumerate(cache[mask]):
                yield mask, signed(u ^ flip), fp, i < singles
        return work

    balls = map_rows(crowded.select("a", "mask"), start, "mask long, z long, fp long, close boolean")
    centre = balls.filter("close").groupBy("mask", "z").agg(F.min("fp").alias("b"))
    return balls.join(centre, ["mask", "z"]).select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def near_links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect fingerprints (column fp, distinct) exactly as all pairs within the distance do."""
    keys = classes.select(F.explode(F.array(*(F.lit(signed(m)) for m in _masks()))).alias("mask"), "fp")
    key = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = keys.repartition(F.col("mask"), key).sortWithinPartitions("mask", key)
    found = stage(dealt.mapInArrow(_runs(crowd), "a long, b long, mask long"), "simhash-links")
    plain = found.filter("mask is null").select("a", "b").distinct()
    crowded = found.filter("mask is not null")
    return plain.union(_through_neighbours(crowded)) if not crowded.isEmpty() else plain


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: fingerprint in hexadecimal and the smallest doc_id that links lead to.

    Null and wordless texts share fingerprint zero and so one component.  Repeated rows give repeated
    results; a null doc_id is never the smallest unless all of its component are null.  An empty
    table gives an empty one; other columns are not looked at.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(near_links(classes.select("fp"), crowd))
    linked = classes.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("first_doc").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    whole = classes.join(named, "fp", "left").select("fp", F.coalesce("component", "first_doc").alias("component_id"))
    return prints.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@exact_names
def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One document of each group, with all of its columns: the one with the smallest id.

    Of rows that share that id one stays, and of a group without any id one.  Every row is told by
    128 bits of hash of its id and text; all columns are kept, whatever their names.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = [F.xxhash64(F.lit(k), id_, F.coalesce(text, F.lit(""))).alias(f"k{k}") for k in (1, 2)]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *keys)
    told = docs.select(*keys, text.alias("text"), id_.cast("long").alias("doc_id"))
    prints = stage(map_rows(told, lambda: lambda k1, k2, text, doc: ((k1, k2, doc, signed(fingerprint(text))),), "k1 long, k2 long, doc_id long, fp long"), "simhash-rows")
    classes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first"))
    roots = components(near_links(classes.select("fp"), crowd))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    # rows that are the same in id and text have one key; of these one stays
    twice = prints.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2")
    kept = marked.join(winners, ["k1", "k2"], "left_semi")
    if not twice.isEmpty():
        doubled = kept.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row")
        kept = kept.join(twice, ["k1", "k2"], "left_anti").select("row").union(doubled)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
