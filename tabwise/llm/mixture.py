"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets are shares of the whole by weight, held below a multiple of what a source has.  A source's
documents fall into blocks by hash; its target asks for a number of draws of blocks, whole passes
first.  A tree halves the output shards again and again and deals the draws of all sources to the
halves without replacement, so every shard has exact quotas.  Each source's blocks are permuted, the
shards take disjoint runs of them, and every shard is shuffled by itself.  What is taken is what the
shards hold.  Only sums of blocks, a bounded number, reach the driver; rows meet their block's shards by
a broadcast of that bounded table, so nothing is shuffled but the mixed rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import local_table
from .common import SPACES, exact_names, pick, stage

#: Words of a block, on average, as long as the numbers below allow.
BLOCK_WORDS = 2_000
#: Blocks of a source, and of all sources together; both bound what is sent to every task.
MAX_BLOCKS, MAX_ALL = 4_096, 400_000
#: Sources a mixture may have: each has a weight of its own, which the driver holds.
MAX_SOURCES = 100_000
#: Draws of blocks dealt to a leaf of the tree, and words of an output shard, on average: a leaf with more is cut again by key.
SHARD_DRAWS, SHARD_WORDS = 64, 20_000_000
#: Keys of an edge block lie below this; ranges of them are narrowed by so many at a time.
KEYS, NARROW = 1 << 60, 1 << 12


def cyclic(k: int) -> float:
    """Weights 3, 1, 2, repeating."""
    return (3.0, 1.0, 2.0)[k % 3]


def fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    target = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        held = set(full)
        open_ = [i for i in open_ if i not in held]
    return target


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws per shard and source as (shard, source, draws): each half of the shards gets a sample without replacement of what its parent has."""
    out = []
    has = np.flatnonzero(quotas)
    work = [(0, shards, has, quotas[has].astype(np.int64))]
    while work:
        a, b, who, q = work.pop()
        if b - a == 1:
            out.append((np.full(len(who), a), who, q))
            continue
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(q, int(q.sum()) * (mid - a) // (b - a), method="marginals") if len(q) else q
        work += [(a, mid, who[left > 0], left[left > 0]), (mid, b, who[q > left], (q - left)[q > left])]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


@dataclass
class Mixture:
    """What decides of every row by its source and key: sources and blocks as tables of bounded size, leaves of the tree and shards cut from a leaf."""

    sources: DataFrame
    blocks: DataFrame
    leaves: int
    cuts: int
    seed: int

    def deal(self, rows: DataFrame, source: Column, key: Column) -> DataFrame:
        """The rows with no, source_size, target, key and ``shards``: one entry for every copy taken."""
        own = rows.withColumn("key", key).join(F.broadcast(self.sources), source.eqNullSafe(F.col("name")))  # MAX_SOURCES rows at most
        own = own.withColumn("block", _hash(self.seed + 1, F.col("key"), F.col("n_blocks")).cast("int"))
        own = own.join(F.broadcast(self.blocks), ["no", "block"])  # MAX_ALL rows, or one a source, at most
        inside = F.col("below").isNull() | (_hash(self.seed + 5, F.col("key"), F.lit(KEYS)) < F.col("below"))
        whole = F.when(inside, F.col("dealt")).otherwise(F.slice("dealt", F.lit(1), F.size("dealt") - 1))
        more = F.array(_hash(self.seed + 6, F.col("key"), F.lit(self.leaves)).cast("int"))
        runs = F.when(F.coalesce(F.col("key") == F.col("fill"), F.lit(False)), F.concat(whole, more)).otherwise(whole)
        return own.withColumn("shards", F.transform(runs, lambda s, i: s * self.cuts + F.pmod(F.xxhash64(F.lit(self.seed + 4), "key", i), F.lit(self.cuts)).cast("int")))


def _hash(seed: int, key: Column, below: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), below)


def _key(seed: int, id_col: Column, source: Column, text: Column) -> Column:
    """Tells rows apart; rows with the same id, source and text are drawn together."""
    return F.xxhash64(F.lit(seed), id_col, source, F.coalesce(text, F.lit("")))


def _edges(edge: DataFrame, missing: dict[int, float]) -> tuple[dict[int, int], dict[int, int]]:
    """Of every source's edge block (no, size, at): the key below which documents are taken until what is missing is reached, and their words.

    Ranges of keys are summed and narrowed, a bounded number at a time, so no block is sorted or gathered."""
    state = {no: (0, KEYS, 0) for no in missing}  # range that holds the limit, words before it
    below: dict[int, int] = {}
    had: dict[int, int] = {}
    while state:
        cuts = max(2, min(NARROW, MAX_ALL // len(state)))
        ranges = local_table(edge.sparkSession, [(no, lo, hi, -(-(hi - lo) // cuts)) for no, (lo, hi, _) in state.items()], "no int, lo long, hi long, wide long")
        inside = edge.join(F.broadcast(ranges), "no").filter("at >= lo and at < hi").withColumn("cut", F.expr("(at - lo) div wide"))
        found: dict[int, list] = {}
        for r in inside.groupBy("no", "cut", "wide").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect():  # MAX_ALL rows, or two a source, at most
            found.setdefault(r.no, []).append(r)
        for no, (lo, hi, words) in list(state.items()):
            del state[no]
            for r in sorted(found.get(no, []), key=lambda r: r.cut):
                if words + r.words > missing[no]:
                    start = lo + r.cut * r.wide
                    if r.n > 1 and r.wide > 1:
                        state[no] = (start, min(hi, start + r.wide), words)
                    else:
                        below[no], had[no] = start, words
                    break
                words += r.words
            else:
                below[no], had[no] = hi, words
    return below, had


def prepare(sized: DataFrame, weight: Callable[[int], float] = cyclic, share: float = 1.5, most: float = 2.0, seed: int = 11) -> Mixture:
    """Plan from a staged table (source, key, size)."""
    spark = sized.sparkSession
    whole = int(most)
    if most != whole:
        raise ValueError("most is a whole number of passes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.n) for r in rows]
    target = fill(sizes, [weight(k) for k in range(len(rows))], share * sum(sizes), most)
    passes = [min(whole, int(t // n)) if n else 0 for t, n in zip(target, sizes)]
    rest = [t - p * n for t, p, n in zip(target, passes, sizes)]
    limit = max(1, min(MAX_BLOCKS, MAX_ALL // max(1, len(rows))))
    n_blocks = [max(1, min(limit, n // BLOCK_WORDS)) for n in sizes]

    def sources(**more: list) -> DataFrame:
        return spark.createDataFrame(pa.table({
            "name": pa.array([r.source for r in rows], pa.string()), "no": pa.array(range(len(rows)), pa.int32()), "n_blocks": pa.array(n_blocks, pa.int32()),
            "source_size": pa.array(sizes, pa.int64()), "target": pa.array(target, pa.float64()), **{k: pa.array(v, pa.int64()) for k, v in more.items()}}))

    named = sized.join(F.broadcast(sources()), F.col("source").eqNullSafe(F.col("name"))).withColumn("block", _hash(seed + 1, F.col("key"), F.col("n_blocks")).cast("int"))
    sums = named.groupBy("no", "block").agg(F.sum("size").alias("words")).toArrow()  # MAX_ALL rows, or one a source, at most
    no, block, words = (sums.column(c).to_numpy() for c in ("no", "block", "words"))
    order = np.lexsort((block, no))
    no, block, words = no[order], block[order], words[order]
    bounds = np.searchsorted(no, np.arange(len(rows) + 1))

    # every source's blocks in a permuted order; draws of a block: all passes, and one more as far as the rest reaches
    rng = np.random.default_rng(seed)
    perms, quota, short = [], np.zeros(len(rows), np.int64), {}
    for k in range(len(rows)):
        perm = bounds[k] + rng.permutation(bounds[k + 1] - bounds[k])
        before = np.cumsum(words[perm]) - words[perm]
        more = before < rest[k]
        perms.append(perm)
        quota[k] = passes[k] * len(perm) + more.sum()
        if more.any():
            last = perm[np.flatnonzero(more)[-1]]
            if before[more][-1] + words[last] > rest[k]:
                short[k] = (int(last), float(rest[k] - before[more][-1]))

    # the tree deals the quotas to leaves; a source's draws take its permuted blocks in turn, every leaf a run of its own
    leaves = max(1, -(-int(quota.sum()) // SHARD_DRAWS))
    cuts = max(1, round(sum(target) / leaves / SHARD_WORDS))
    leaf, who, draws = split(quota, leaves, rng)
    by_source = np.lexsort((leaf, who))
    leaf, who, draws = leaf[by_source], who[by_source], draws[by_source]
    ends = np.searchsorted(who, np.arange(len(rows) + 1))
    at, shard = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, perm in enumerate(perms):
        runs = np.repeat(leaf[ends[k]:ends[k + 1]], draws[ends[k]:ends[k + 1]])
        at.append(perm[np.arange(len(runs)) % max(1, len(perm))])
        shard.append(runs)
    at, shard = np.concatenate(at), np.concatenate(shard)
    by_block = np.argsort(at, kind="stable")
    dealt = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[by_block], np.arange(len(no) + 1)), pa.int32()), pa.array(shard[by_block], pa.int32()))

    # in the block where the rest ends, documents are taken by their keys until it is reached
    edge = named.join(F.broadcast(local_table(spark, [(k, int(block[b])) for k, (b, _) in short.items()], "no int, block int")), ["no", "block"])  # one row a source
    edge = edge.select("no", "size", _hash(seed + 5, F.col("key"), F.lit(KEYS)).alias("at"))
    below, had = _edges(edge, {k: r for k, (_, r) in short.items()})
    limits: list = [None] * len(no)
    for k, (b, _) in short.items():
        limits[b] = below[k]
    blocks = spark.createDataFrame(pa.table({"no": pa.array(no, pa.int32()), "block": pa.array(block, pa.int32()), "dealt": dealt, "below": pa.array(limits, pa.int64())}))
    found = Mixture(sources(fill=[None] * len(rows)), blocks, leaves, cuts, seed)

    # of the documents left, the one that comes nearest to what is still missing completes the source
    gap = {k: r - had[k] for k, (_, r) in short.items()}
    if gap:
        missing = F.broadcast(local_table(spark, [(k, g, passes[k]) for k, g in gap.items()], "no int, gap double, passes int"))  # one row a source
        off = F.abs(F.col("size") - F.col("gap"))
        free = found.deal(sized, F.col("source"), F.col("key")).join(missing, "no").filter((F.size("shards") == F.col("passes")) & (F.col("passes") < whole) & (off < F.col("gap")))
        nearest = {r.no: r.key for r in free.groupBy("no").agg(F.min(F.struct(off.alias("off"), "key"))["key"].alias("key")).collect()}
        # rows that share the key come together; they may be too many
        same = local_table(spark, list(nearest.items()), "no int, key long")
        total = {r.no: r.n for r in named.join(F.broadcast(same), ["no", "key"]).groupBy("no").agg(F.sum("size").alias("n")).collect()}
        chosen = {k: key for k, key in nearest.items() if abs(total[k] - gap[k]) < gap[k]}
        found.sources = sources(fill=[chosen.get(k) for k in range(len(rows))])
    return found


@exact_names
def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    d = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACES)).cast("long")
    return stage(d.select("doc_id", "source", _key(seed, F.col("doc_id"), F.col("source"), F.col("text")).alias("key"), size.alias("size")), "mixture-sizes")


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Callable[[int], float] = cyclic,
                 share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, key, size, source_size, target, taken, shards (one per copy taken).

    Sources are weighed in code point order, null last.  Null texts have size 0; a source without words has target 0 and is
    not taken.  The words taken of a source differ from its target by less than a document, mostly by a few words; rows
    that are equal in id, source and text are drawn together and count as one document there.  Reruns agree.  An empty
    table gives an empty one; other columns are not looked at.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    found = prepare(sized, weight, share, most, seed).deal(sized, F.col("source"), F.col("key"))
    return found.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


@exact_names
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Callable[[int], float] = cyclic,
        share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed rows: all columns of the documents taken, once per copy, with shard, copy and place (the order in a shard).

    Result columns that the documents already have are replaced; all other columns are kept, whatever their names."""
    plan = prepare(_sized(docs, id_col, text_col, source_col, seed), weight, share, most, seed)
    kept = [c for c in docs.columns if c not in ("shard", "copy", "place")]
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), _key(seed, id_, source, text).alias("k"), source.alias("s"))
    rows = plan.deal(rows, F.col("s"), F.col("k")).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.select("row", "copy", "shard", F.xxhash64(F.lit(seed + 3), "key", "copy").alias("place")).repartition("shard").sortWithinPartitions("shard", "place")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), "copy", "shard", "place")
