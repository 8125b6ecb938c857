"""Token counts by a linear longest-match automaton.

A word is cut greedily into the longest pieces of a vocabulary: first a piece that may begin a word,
then pieces that continue one.  The trie of all pieces gets failure links: where no further byte
fits, the link leads to the state after the pieces that are certain by then, and their number is
stored with it.  A word is read once, byte by byte; pieces are never built.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows, pick

#: Pieces a vocabulary may have; it is held by every task.
MAX_PIECES = 2_000_000
#: Words whose counts a task remembers; beyond, it forgets all and goes on.
REMEMBERED = 400_000


class Automaton:
    """Counts greedy pieces.  ``first`` begin a word, ``rest`` continue it; a word that cannot be cut counts one unknown."""

    def __init__(self, first: set[bytes], rest: set[bytes]):
        if not all(first) or not all(rest):
            raise ValueError("a piece is empty")
        # state 0 begins a word, state 1 continues it
        step: dict[int, int] = {}
        back, popped, children = [-1, -1], [0, 0], [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = children[at].get(c)
                    if to is None:
                        to = len(children)
                        children[at][c] = to
                        children.append({})
                        back.append(-1)
                        popped.append(0)
                        whole.append(False)
                    at = to
                whole[at] = True
        level = [0, 1]
        while level:
            below = []
            for at in level:
                for c, to in children[at].items():
                    below.append(to)
                    if whole[to]:
                        back[to], popped[to] = 1, 1
                        continue
                    z, n = back[at], popped[at]
                    while z >= 0 and c not in children[z]:
                        n += popped[z]
                        z = back[z]
                    if z >= 0:
                        back[to], popped[to] = children[z][c], n
            level = below
        for at, kids in enumerate(children):
            for c, to in kids.items():
                step[at << 8 | c] = to
        self.step, self.back, self.popped = step, back, popped

    def count(self, word: bytes) -> tuple[int, int]:
        """Pieces and unknowns of one word."""
        step, back, popped = self.step, self.back, self.popped
        at, n = 0, 0
        for c in word:
            to = step.get(at << 8 | c)
            while to is None:
                n += popped[at]
                at = back[at]
                if at < 0:
                    return 1, 1
                to = step.get(at << 8 | c)
            at = to
        while at != 1:
            n += popped[at]
            at = back[at]
            if at < 0:
                return (1, 1) if word else (0, 0)
        return n, 0


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a .tiktoken file (rank lines) or of a tokenizer .json whose pieces use byte letters."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".tiktoken"):
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        else:
            letters = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
            missing = [b for b in range(256) if b not in letters.values()]
            letters |= {chr(256 + i): b for i, b in enumerate(missing)}
            pieces = [bytes(letters[c] for c in p) for p in json.load(f)["model"]["vocab"] if all(c in letters for c in p)]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces are more than {MAX_PIECES}")
    return pieces


@lru_cache(maxsize=2)
def built(pieces: tuple[bytes, ...]) -> Automaton:
    """The automaton of a vocabulary whose word beginnings carry a space, kept between the tasks of a worker."""
    return Automaton({p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "})


def count_tokens(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, greedy pieces, unknown words, the longest word's pieces, code points.

    Words are runs without white space, each read with one space before it.  Null text counts as
    empty (all zero); an empty table gives an empty one; other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(pieces))

    def start():
        auto = built(held.value)
        known: dict[bytes, tuple[int, int]] = {}

        def work(doc, text):
            words = (text or "").encode().split()
            total = unknown = most = 0
            for w in words:
                got = known.get(w)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    got = auto.count(b" " + w)
                    if len(w) <= 100:
                        known[w] = got
                total += got[0]
                if got[1]:
                    unknown += 1
                if got[0] > most:
                    most = got[0]
            yield doc, len(words), total, unknown, most, len(text or "")
        return work

    return map_rows(pick(docs, id_col, text_col), start, "doc_id long, n_words long, n_tokens long, n_unknown long, max_word_tokens long, n_chars long")
