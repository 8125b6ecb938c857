"""Packing into sequences by vector bin packing: limits on tokens, segments and loss-bearing tokens at once.

Tasks tokenise whole texts and cut them into pieces; only lengths and checksums move on.  Pieces are dealt
to groups of about equal size, and each group is packed by itself: a sequence is opened, and the piece with
the largest dot product of its demands and the room left is put in, again and again, until none fits.
Sequences that would need more than a little padding are taken apart: their pieces are cut at the binary
digits of their lengths, and such parts fill sequences exactly.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import pick, stage

#: Tokens, segments and loss-bearing tokens a sequence may hold.
LIMITS = (2048, 128, 2048)
#: Padding that a sequence may keep, as a share of its room.
PADDING = 1 / 128
#: Id that ends a document.
END = 1
#: Pieces of a group, on average.
GROUP = 2_000
#: Words of a generation that a worker remembers, none longer than the bytes stated.
REMEMBERED, WORD_BYTES = 600_000, 100
#: ASCII signs that are neither letter, digit nor space.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Bytes of text that are tokenised at a time; a longer text is alone.
AT_ONCE = 16_000_000


# ---------------------------------------------------------------- tokens


class WordIds:
    """Ids of texts.

    ASCII white space separates words before anything else, so a word's ids are those it has alone.  Two generations of
    words are remembered: a full one takes the place of the one before it, so frequent words stay.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that end a run of letters
        self.ends[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin; null texts have none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        distinct, place = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
        own = self._ids(distinct)
        flat, count = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        start, many = np.cumsum(count) - count, count[place]
        ends = np.cumsum(many)
        ids = flat[np.arange(many.sum()) + np.repeat(start[place] - ends + many, many)]
        return ids, np.r_[0, ends][lists.offsets.to_numpy()]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        known, before = self.known, self.before
        runs, others, joined = set(), set(), []
        for w in words:
            if w in known:
                continue
            if w in before:
                known[w] = before[w]
                continue
            # letters followed by ASCII signs are two parts that do not touch; the letters' case is of no account
            stem = w.rstrip(SIGNS)
            if stem.isalpha() or not stem.isascii() and stem.decode().isalpha():
                p, tail = stem.lower(), w[len(stem):]
                if p != w:
                    joined.append((w, p, tail))
                if p not in known:
                    if p in before:
                        known[p] = before[p]
                    else:
                        runs.add(p)
                if tail and tail not in known:
                    others.add(tail)
            else:
                others.add(w)
        if runs:
            # letters alone are one run, whose last piece, and no other, is one that ends it
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(runs).decode()], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(runs):
                raw, last = ids.tobytes(), (4 * last).tolist()
                known.update(zip(runs, map(raw.__getitem__, map(slice, [0, *last], last))))
            else:  # a letter that is several signs in lower case
                others |= runs
        for p, e in zip(others, self.tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False)):
            known[p] = np.array(e.ids, "<u4").tobytes()
        for w, p, tail in joined:
            known[w] = known[p] + known[tail] if tail else known[p]
        out = [known[w] for w in words]
        if len(known) > REMEMBERED:
            self.known, self.before = {}, {w: v for w, v in known.items() if len(w) <= WORD_BYTES}
        return out


@lru_cache(maxsize=2)
def word_ids(tokenizer_json: str) -> WordIds:
    """Kept between the tasks of a worker."""
    return WordIds(tokenizer_json)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with texts in its second column, in parts of about AT_ONCE bytes."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def digits(n: int) -> list[int]:
    """Powers of two that make up n, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, parts array<long>"


def cut_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", most: int = LIMITS[0], end: int | None = END) -> DataFrame:
    """Pieces of at most ``most`` ids: doc_id, start, length, ids_crc32, doc_tokens, loss, parts.

    Only a document's last piece is shorter; ``parts`` are the checksums of its cuts at the binary digits of its length.
    Every id but a piece's first one bears loss.  A null text is empty and still has its end id.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def cut(doc: int | None, raw: bytes) -> Iterator[tuple]:
        n = len(raw) // 4
        for at in range(0, n, most):
            length = min(most, n - at)
            parts, p = [], at
            for size in digits(length) if length < most else ():
                parts.append(zlib.crc32(raw[4 * p:4 * (p + size)]))
                p += size
            yield doc, at, length, zlib.crc32(raw[4 * at:4 * (at + length)]), n, length - 1, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(held.value)
        for b in batches:
            for part in slices(b):
                ids, starts = encode(part.column(1))
                rows = [r for doc, x, y in zip(part.column(0).to_pylist(), starts.tolist(), starts[1:].tolist()) for r in cut(doc, ids[x:y].tobytes() + last)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.list_(pa.int64())])], PIECE.split()[::2])

    return pick(docs, id_col, text_col).mapInArrow(run, PIECE)


# ---------------------------------------------------------------- packing of one group


def place(demand: np.ndarray, limits: tuple[int, ...]) -> list[list[int]]:
    """Sequences as lists of rows of ``demand``, in the order placed; rows beyond a limit by themselves are left out.

    Rows alike are one kind.  The dot product weighs every demand by its share of the limit and by how much of it all
    rows ask for; equal products go to the larger demand, then to the smaller row.
    """
    limit = np.array(limits, np.int64)
    fits = (demand <= limit).all(1)
    rows = np.flatnonzero(fits)
    kinds, which = np.unique(demand[rows], axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    waiting = np.split(rows[order], np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))[:-1]) if len(rows) else []
    left = np.array([len(w) for w in waiting], np.int64)
    share = kinds / limit
    weight = (share * left[:, None]).sum(0) / max(1, len(rows))
    out = []
    while left.any():
        room, members = limit.copy(), []
        live = np.flatnonzero(left)
        while True:
            live = live[(kinds[live] <= room).all(1) & (left[live] > 0)]
            if not len(live):
                break
            # kinds are in rising order, so the last of equal products is the largest
            k = live[len(live) - 1 - int(np.argmax((share[live] @ (weight * room / limit))[::-1]))]
            members.append(int(waiting[k][len(waiting[k]) - left[k]]))
            left[k] -= 1
            room = room - kinds[k]
        out.append(members)
    return out


def padding(tokens: int, room: int) -> int:
    """Sequences are padded to the full room, but those of a power of two are not."""
    return 0 if tokens & (tokens - 1) == 0 else room - tokens


def exact(sizes: list[int], loss: list[int], limits: tuple[int, ...]) -> list[list[int]]:
    """Parts whose sizes are powers of two in sequences without padding, for a room that is a power of two."""
    out: list[list[int]] = []

    def close(members: list[int]) -> None:
        # of falling powers of two, the first ones add up exactly to the largest power within their total
        while members:
            total, goal = 0, digits(sum(sizes[i] for i in members))[0]
            for n, i in enumerate(members, 1):
                total += sizes[i]
                if total == goal:
                    break
            out.append(members[:n])
            members = members[n:]

    now: list[int] = []
    tokens = bearing = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if now and (tokens + sizes[i] > limits[0] or len(now) == limits[1] or bearing + loss[i] > limits[2]):
            close(now)
            now, tokens, bearing = [], 0, 0
        now.append(i)
        tokens, bearing = tokens + sizes[i], bearing + loss[i]
    close(now)
    return out


def _pack_group(limits: tuple[int, ...], most_padding: float) -> Callable[[pa.Table], pa.Table]:
    keep = int(limits[0] * most_padding)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number = group.column("grp")[0].as_py()
        col = {n: group.column(n).to_pylist() for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "parts")}
        demand = np.array([col["length"], [1] * group.num_rows, col["loss"]], np.int64).T
        out, apart, sequence = [], [], 0

        def add(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, crc, tokens in pieces:
                out.append((doc, start, length, crc, tokens, number << 20 | sequence, offset))
                offset += length
            sequence += 1

        for members in place(demand, limits):
            spare = padding(sum(col["length"][i] for i in members), limits[0])
            if spare > keep and all(col["parts"][i] for i in members):
                apart += members
            else:
                add([(col["doc_id"][i], col["start"][i], col["length"][i], col["ids_crc32"][i], col["doc_tokens"][i]) for i in members])
        cut = []
        for i in apart:
            at = col["start"][i]
            for size, crc in zip(digits(col["length"][i]), col["parts"][i]):
                cut.append((col["doc_id"][i], at, size, crc, col["doc_tokens"][i]))
                at += size
        for members in exact([c[2] for c in cut], [c[2] - 1 for c in cut], limits):
            add([cut[i] for i in members])
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * len(names))], names=names)

    return run


# ---------------------------------------------------------------- operators


def _dealt(rows: DataFrame, group_rows: int) -> DataFrame:
    """Rows of a staged table with the number of a group; equal rows are spread as well."""
    groups = max(1, -(-rows.count() // group_rows))
    return rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))


def pack_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] = LIMITS,
                   most_padding: float = PADDING, group_rows: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; a null doc_id is kept.  Rows are packed each for themselves, also with equal
    ids and texts; an empty table gives an empty one; other columns are not looked at.  A sequence without a power of
    two of tokens needs at most ``most_padding`` of its room as padding.  The room is a power of two; loss-bearing tokens
    are limited to no less than the room, since a full piece must fit.
    """
    if limits[0] & (limits[0] - 1) or limits[2] < limits[0]:
        raise ValueError("the room is a power of two, and loss-bearing tokens may fill it")
    pieces = stage(cut_documents(docs, tokenizer_json, id_col, text_col, limits[0]), "packing-pieces")
    return _dealt(pieces, group_rows).groupBy("grp").applyInArrow(
        _pack_group(limits, most_padding), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def examples_of_turns(turns: DataFrame, tokenizer_json: str, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """Instruction data: (conv_id, tokens, segments, loss) of every conversation; its turns are segments, and the tokens of the learned role bear loss.

    Null texts are empty; turns without a conversation are left out.
    """
    held = turns.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(held.value)
        for b in batches:
            for part in slices(b):
                tokens = np.diff(encode(part.column(1))[1]) + 1  # every turn has an end
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pc.fill_null(pc.equal(part.column(2), learned), False)], ["conv_id", "tokens", "bears"])

    own = pick(turns, conv_col, text_col, role_col).filter(F.col(f"`{conv_col}`").isNotNull())
    each = own.mapInArrow(run, "conv_id long, tokens long, bears boolean")
    return each.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum(F.when(F.col("bears"), F.col("tokens")).otherwise(0)).alias("loss"))


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = LIMITS, group_rows: int = GROUP) -> DataFrame:
    """Whole examples (conv_id, tokens, segments, loss) with sequence_id and offset; those beyond a limit have nulls there."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("conv_id", "ascending"), ("tokens", "ascending"), ("segments", "ascending"), ("loss", "ascending")])
        number = group.column("grp")[0].as_py()
        demand = np.array([group.column(c).to_pylist() for c in ("tokens", "segments", "loss")], np.int64).T
        sequence, offset = [None] * group.num_rows, [None] * group.num_rows
        for k, members in enumerate(place(demand, limits)):
            at = 0
            for i in members:
                sequence[i], offset[i] = number << 20 | k, at
                at += int(demand[i, 0])
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    rows = stage(examples.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("tokens", "segments", "loss"))), "packing-examples")
    return _dealt(rows, group_rows).groupBy("grp").applyInArrow(run, "conv_id long, tokens long, segments long, loss long, sequence_id long, offset long")
