"""Substring dedup: words of repeated 13-word windows go, but for the document with the smallest id.

1. Every window is stood for by its smallest five-word hash (minimizer).  A window that two documents
   share has a minimizer that two documents share, so only such windows are looked at further; one in
   about five words gives a minimizer.
2. Documents are dealt to shards by their id.  Each shard sends one row for every distinct window with
   a shared minimizer, with its smallest document; rows that meet confirm a window and name its owner.
3. The owner's shard puts confirmed windows that follow each other together to passages, and sends each
   passage once to every shard that repeats it.
4. Each shard compiles its passages into an Aho-Corasick automaton of their minimizer phrases and streams
   all of its documents through it; places around what it finds are compared with the passages word by
   word, and words that an earlier owner covers are removed.

A key that very many documents share is cut down where it arises: a batch names it once and tells
the others' shards without sending them to the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows, pick

WINDOW = 13
GRAM = 5
NO_DOC = -(1 << 63)
#: Text bytes of a shard, on average.
SHARD_BYTES = 8_000_000
#: Documents that are split into words at a time, where no more is needed at once.
AT_ONCE = 1_000
_ODD = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)
_ODD2 = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


class Words:
    """Words of several texts, one after another: numbers of words, their hashes, and the text of each place."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        real = pc.binary_length(words).to_numpy() > 0  # spaces at either end leave empty words
        self.words = words.filter(pa.array(real))
        self.offsets = np.r_[0, np.cumsum(real)][offsets]
        self.lengths = np.diff(self.offsets)
        coded = self.words.dictionary_encode()
        self.number = coded.indices.to_numpy()
        self.distinct = len(coded.dictionary)
        known = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, self.distinct)
        self.hash = known[self.number] if self.distinct else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(texts)), self.lengths)

    def __len__(self) -> int:
        return len(self.hash)

    def inside(self) -> np.ndarray:
        """For every place where a window of words starts: does it end in the same text?"""
        return self.text[:len(self) - WINDOW + 1] == self.text[WINDOW - 1:]


def rolling(a: np.ndarray, n: int, odd: np.ndarray) -> np.ndarray:
    """Hash of every n consecutive numbers."""
    m = len(a) - n + 1
    h = a[:m] * odd[0]
    for j in range(1, n):
        h += a[j:j + m] * odd[j]
    return h


def minimizers(a: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every window, the smallest hash of the grams in it; needs a whole window."""
    g = rolling(a, GRAM, _ODD)
    m = len(a) - window + 1
    low = g[:m].copy()
    for j in range(1, window - GRAM + 1):
        np.minimum(low, g[j:j + m], out=low)
    return low


def window_hashes(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of the windows that start at some places."""
    return rolling(a, WINDOW, _ODD)[at], (rolling(a, WINDOW, _ODD2)[at] >> np.uint64(32)).astype(np.uint32)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimizers of a batch of documents: (flags, key, doc).

    Flags 0 and 1 ask: is ``key`` shared?  1 knows that it is, since the batch has it in several
    documents, and asks so that other batches learn of it.  2 tells the shard of one more document.
    """
    for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
        known = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
        ids, shards = pc.fill_null(batch.column(0), 0).to_numpy(), pc.fill_null(batch.column(2), 0).to_numpy()
        words = Words(batch.column(1))
        keys, docs, owners = [], [], []
        for i in np.flatnonzero(known & (words.lengths >= WINDOW)):
            k = np.unique(minimizers(words.hash[words.offsets[i]:words.offsets[i + 1]]))
            keys.append(k)
            docs.append(np.full(len(k), ids[i], np.int64))
            owners.append(np.full(len(k), shards[i], np.int32))
        if not keys:
            continue
        key, doc, shard = np.concatenate(keys), np.concatenate(docs), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, doc, shard = key[order], doc[order], shard[order]
        asks = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(asks)
        size = np.diff(np.r_[start, len(key)])
        many = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), size)
        # of the documents of a shared key, one row per shard is enough
        more = np.flatnonzero(many)
        group = np.repeat(np.arange(len(start)), size)[more]
        pair = np.lexsort((~asks[more], shard[more], group))
        fresh = np.r_[True, (group[pair[1:]] != group[pair[:-1]]) | (shard[more[pair[1:]]] != shard[more[pair[:-1]]])] if len(more) else np.zeros(0, bool)
        tell = np.zeros(len(key), bool)
        tell[more[pair[fresh]]] = True
        tell &= ~asks
        rows = np.concatenate([np.flatnonzero(asks), np.flatnonzero(tell)])
        flags = np.r_[many[asks].astype(np.int8), np.full(tell.sum(), 2, np.int8)]
        yield pa.RecordBatch.from_arrays([pa.array(flags), pa.array(key[rows].view(np.int64)), pa.array(doc[rows])], ["flags", "key", "doc"])


def _answer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (told, key, doc): the (doc, key) of keys that several documents have; holds one row of a key."""
    held = None  # key, doc, known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        flags, key, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
        out = flags == 2
        ask = np.flatnonzero(flags < 2)
        extra: list[tuple[int, int]] = []
        if len(ask):
            k, d, m = key[ask], doc[ask], flags[ask] == 1
            start = np.r_[True, k[1:] != k[:-1]]
            group = np.cumsum(start) - 1
            shared = np.bincount(group, m, group[-1] + 1) + np.bincount(group[1:], ~start[1:] & (d[1:] != d[:-1]), group[-1] + 1) > 0
            if held is not None and held[0] == k[0]:
                joined = shared[0] or held[2] or held[1] != d[0]
                if joined and not held[2]:
                    extra.append((held[1], held[0]))
                shared[0] = joined
            out[ask] = shared[group]
            held = (k[-1], d[-1], bool(shared[group[-1]]))
        dd, kk = doc[out], key[out]
        if extra:
            dd, kk = np.r_[dd, np.array([e[0] for e in extra], dd.dtype)], np.r_[kk, np.array([e[1] for e in extra], kk.dtype)]
        if len(dd):
            yield pa.RecordBatch.from_arrays([pa.array(dd), pa.array(kk)], ["doc", "key"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids (the smallest number where there is none) and texts of packed documents."""
    unpack = zstandard.ZstdDecompressor()
    texts = pa.array((unpack.decompress(z) for z in table.column("z").to_pylist()), pa.large_binary()).cast(pa.large_string())
    return pc.fill_null(table.column("doc"), NO_DOC).to_numpy(), texts


def _windows(docs: pa.Table, keys: pa.Table) -> pa.Table:
    """One row per distinct window of a shard with a shared minimizer: hashes, smallest document, in several documents or not."""
    wanted = np.unique(keys.column("key").to_numpy().view(np.uint64))
    found: list[tuple[np.ndarray, ...]] = []
    for first in range(0, docs.num_rows if len(wanted) else 0, AT_ONCE):
        ids, texts = _unpacked(docs.slice(first, AT_ONCE))
        words = Words(texts)
        if len(words) < WINDOW:
            continue
        low = minimizers(words.hash)
        near = np.searchsorted(wanted, low)
        at = np.flatnonzero((wanted[np.minimum(near, len(wanted) - 1)] == low) & words.inside())
        at = at[ids[words.text[at]] != NO_DOC]
        if len(at):
            h1, h2 = window_hashes(words.hash, at)
            found.append((h1, h2, ids[words.text[at]]))
    if found:
        h1, h2, doc = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h1, kind="stable")
        h1, h2, doc = h1[order], h2[order], doc[order]
        start = np.flatnonzero(np.r_[True, h1[1:] != h1[:-1]])
        if (np.minimum.reduceat(h2, start) != np.maximum.reduceat(h2, start)).any():  # different windows with one h1
            order = np.lexsort((h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        low = np.minimum.reduceat(doc, start)
        many = np.maximum.reduceat(doc, start) != low
        h1, h2, doc = h1[start], h2[start], low
    else:
        h1, h2, doc, many = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
    return pa.table({"h1": h1.view(np.int64), "h2": h2.view(np.int32), "doc": doc, "many": many})


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h1, h2, doc): each confirmed window's owner, with a document of every shard that repeats it."""
    held = None  # h1, h2, owner
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, many = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        owner = doc[np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))].copy()
        if held is not None and held[:2] == (h1[0], h2[0]):
            new[0] = False
            owner[:np.r_[np.flatnonzero(new), len(new)][0]] = held[2]
        held = (h1[-1], h2[-1], owner[-1])
        say = many | ~new
        if say.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[say]) for x in (owner, h1, h2, doc)], ["owner", "h1", "h2", "to_doc"])


def _passages(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Passages of a shard's documents that hold confirmed windows they own: (dest, owner, passage), one for each run of windows and shard."""
    h1, h2, owner, dest = (wanted.column(c).to_numpy() for c in ("h1", "h2", "owner", "dest"))
    order = np.lexsort((dest, h2, h1.view(np.uint64)))
    h1, h2, owner, dest = h1[order].view(np.uint64), h2[order].view(np.uint32), owner[order], dest[order]
    start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(h1)])
    k1, k2, k_owner = h1[start], h2[start], owner[start]
    out = []
    for first in range(0, docs.num_rows if len(k1) else 0, AT_ONCE):
        ids, texts = _unpacked(docs.slice(first, AT_ONCE))
        words = Words(texts)
        if len(words) < WINDOW:
            continue
        r1 = rolling(words.hash, WINDOW, _ODD)
        near = np.minimum(np.searchsorted(k1, r1), len(k1) - 1)
        at = np.flatnonzero((k1[near] == r1) & words.inside())
        if not len(at):
            continue
        r2 = window_hashes(words.hash, at)[1]
        key, found = _met(k1, k2, r1[at], r2)
        own = found & (k_owner[np.maximum(key, 0)] == ids[words.text[at]])
        at, key = at[own], key[own]
        # every shard that wants a window, and runs of windows that follow each other
        each = np.repeat(np.arange(len(at)), count[key])
        rank = np.arange(len(each)) - np.repeat(np.cumsum(count[key]) - count[key], count[key])
        to, place = dest[start[key[each]] + rank], at[each]
        order = np.lexsort((place, to))
        to, place = to[order], place[order]
        head = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (place[1:] != place[:-1] + 1)]) if len(to) else np.zeros(0, np.int64)
        last = np.r_[head[1:], len(to)] - 1
        length = place[last] - place[head] + WINDOW
        pieces = np.repeat(place[head] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int64()), words.words.take(pa.array(pieces)))
        texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        out.append(pa.table({"dest": pa.array(to[head], pa.int32()), "owner": pa.array(ids[words.text[place[head]]], pa.int64()), "passage": texts.cast(pa.string())}))
    return pa.concat_tables(out) if out else pa.table({"dest": pa.array([], pa.int32()), "owner": pa.array([], pa.int64()), "passage": pa.array([], pa.string())})


def _met(k1: np.ndarray, k2: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of (r1, r2) in a table sorted by (k1, k2), and whether they are there; equal k1 may stand for several windows."""
    at = np.searchsorted(k1, r1)
    found = np.zeros(len(r1), bool)
    open_ = np.arange(len(r1))
    while len(open_):
        open_ = open_[at[open_] < len(k1)]
        open_ = open_[k1[at[open_]] == r1[open_]]
        same = k2[at[open_]] == r2[open_]
        found[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
    return at, found


def automaton(phrases: np.ndarray, distinct: int) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """Aho-Corasick automaton over phrases of GRAM word numbers, two letters a word, and the letters of all words.

    Letters are numbered in a square just large enough, which keeps the branching of a state small."""
    used = np.unique(phrases)
    side = int(len(used) ** 0.5) + 2
    letters = np.full((distinct, 2), 1, np.uint32)
    letters[used] = 256 + np.stack(np.divmod(np.arange(len(used)), side), 1)
    built = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    text = spelled(letters, phrases.ravel())
    for at in range(0, len(text), 2 * GRAM):
        built.add_word(text[at:at + 2 * GRAM])
    built.make_automaton()
    return built, letters


def spelled(letters: np.ndarray, numbers: np.ndarray) -> str:
    return letters[numbers].astype("<u4").tobytes().decode("utf-32-le")


def _equal(words: Words, at: np.ndarray, known: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """For every window, a place of ``known`` (sorted by their hashes h1) that has the same words, or -1."""
    hashes = rolling(words.hash, WINDOW, _ODD)[at]
    near = np.searchsorted(h1, hashes)
    out = np.full(len(at), -1, np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        open_ = open_[near[open_] < len(h1)]
        open_ = open_[h1[near[open_]] == hashes[open_]]
        same = np.ones(len(open_), bool)
        for j in range(WINDOW):
            same &= words.number[at[open_] + j] == words.number[known[near[open_]] + j]
        out[open_[same]] = near[open_[same]]
        open_ = open_[~same]
        near[open_] += 1
    return out


def _remove(docs: pa.Table, passages: pa.Table, keep_text: bool) -> pa.Table:
    """Results of a shard's documents, given the passages that earlier documents own."""
    ids, texts = _unpacked(docs)
    # passages are read behind the documents, so that both number their words alike
    words = Words(pa.concat_arrays([texts, passages.column("passage").combine_chunks().cast(pa.large_string())]) if passages.num_rows else texts)
    own = words.offsets[docs.num_rows]
    keep = np.ones(own, bool)
    places = _find(words, own) if passages.num_rows else np.zeros(0, np.int64)
    if len(places):
        known = own + np.flatnonzero(words.inside()[own:])
        h1 = rolling(words.hash, WINDOW, _ODD)[known]
        order = np.argsort(h1, kind="stable")
        known, h1 = known[order], h1[order]
        met = _equal(words, places, known, h1)
        owner = passages.column("owner").to_numpy()[words.text[known[met]] - docs.num_rows]
        places = places[(met >= 0) & (owner < ids[words.text[places]])]
        cover = np.zeros(own + 1, np.int32)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + WINDOW, -1)
        keep = np.cumsum(cover[:-1]) == 0
    offsets = np.r_[0, np.cumsum(keep)][words.offsets[:docs.num_rows + 1]]
    left = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.words[:own].filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
    digests = [hashlib.sha256(t).hexdigest() for t in left.cast(pa.large_binary()).to_pylist()]
    lengths = words.lengths[:docs.num_rows]
    return pa.table({
        "doc_id": docs.column("doc"), "n_words": pa.array(lengths, pa.int64()), "n_removed": pa.array(lengths - np.diff(offsets), pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()), "kept_text": left.cast(pa.string()) if keep_text else pa.nulls(len(left), pa.string()),
    })


def _find(words: Words, own: int) -> np.ndarray:
    """Windows of the documents (the first ``own`` words) around phrases of the passages (the words behind), found by an automaton."""
    phrases = _phrases(words, own)
    search, letters = automaton(words.number[phrases[:, None] + np.arange(GRAM)], words.distinct)
    ends = np.fromiter((end for end, _ in search.iter(spelled(letters, words.number[:own]))), np.int64)
    ends = ends[ends % 2 == 1] // 2
    m = max(0, own - WINDOW + 1)
    near = np.zeros(m + 1, np.int32)  # windows that hold a phrase which ends at word e start in e-12 .. e-4
    np.add.at(near, np.clip(ends - WINDOW + 1, 0, m), 1)
    np.add.at(near, np.clip(ends - GRAM + 2, 0, m), -1)
    return np.flatnonzero((np.cumsum(near[:m]) > 0) & words.inside()[:m])


def _phrases(words: Words, own: int) -> np.ndarray:
    """Places of the minimizer phrases of the passages' windows, one place for each phrase."""
    at = own + np.flatnonzero(words.inside()[own:])
    value, first = np.unique(minimizers(words.hash[own:])[at - own], return_index=True)
    gram = rolling(words.hash, GRAM, _ODD)
    inside = gram[at[first][:, None] + np.arange(WINDOW - GRAM + 1)] == value[:, None]
    return at[first] + inside.argmax(1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: words, removed words, digest and text of what is left.

    A word goes if some 13-word window over it also starts in a document with a smaller doc_id.
    Null text counts as empty; texts under 13 words stay whole.  Rows with one doc_id do not remove each
    other's words; a row with a null doc_id stays whole and removes nothing.  An empty table gives an
    empty one; other columns are not looked at.
    """
    d = pick(docs, id_col, text_col).toDF("doc", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def to_shard(doc: str) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int")

    d = d.withColumn("shard", to_shard("doc"))
    asked = d.mapInArrow(_shared_keys, "flags tinyint, key long, doc long")
    told = F.col("flags") == 2
    spread = F.when(told, F.xxhash64("key", "doc")).otherwise(F.col("key"))
    keys = (asked.repartition(spread).sortWithinPartitions(told, "key", "doc").mapInArrow(_answer_keys, "doc long, key long")).withColumn("shard", to_shard("doc"))

    def start():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda doc, text, shard: ((shard, doc, pack.compress((text or "").encode())),)

    # dealt out once; all steps below read the same shuffle
    packed = map_rows(d.select("doc", "text", "shard"), start, "shard int, doc long, z binary")
    windows = packed.groupBy("shard").cogroup(keys.select("shard", "key").groupBy("shard")).applyInArrow(_windows, "h1 long, h2 int, doc long, many boolean")
    known = windows.repartition("h1").sortWithinPartitions("h1", "h2", "doc").mapInArrow(_owners, "owner long, h1 long, h2 int, to_doc long")
    known = known.select(to_shard("owner").alias("shard"), "owner", "h1", "h2", to_shard("to_doc").alias("dest"))
    passages = packed.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_passages, "dest int, owner long, passage string")
    return packed.groupBy("shard").cogroup(passages.groupBy("dest")).applyInArrow(
        lambda docs, found: _remove(docs, found, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
