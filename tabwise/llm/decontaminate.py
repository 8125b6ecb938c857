"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question whose parameters were changed has
the same template.  Windows of template tokens of the benchmark are matched by hash against those of
every document; matches that line up cover an item, and the values behind its placeholders must map
consistently from item to document.  All windows are matched a second time by their lower-case words
alone, so exact copies are found whatever they are made of.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import keep_rows, map_rows, pick, ship

#: Template tokens of a window; items with fewer have one window, as long as they are.
WINDOW = 8
#: Least tokens of an item that can be found with other values; an exact copy is found from one word on.
LEAST = 3
#: Part of a template window's tokens that must be words of its own, not placeholders.
LITERAL = 0.5
#: An item counts as leaked if so large a part, or so many of its tokens in a row, is covered.
COVER, RUN = 0.5, 13
#: Largest part of an item's covered slots that may map inconsistently.
LOOSE = 0.2
#: Windows of the benchmark that a task holds; more are gone through in parts.
MAX_WINDOWS = 2_000_000
REMEMBERED = 400_000

NUMBER = re.compile(rb"[$\xe2\x82\xac#]*[+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%|[A-Za-z]{1,3})?")
#: Units count as such after a number.
UNITS = frozenset(
    b"mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces gram grams kilogram kilograms ton tons ml cl l liter liters litre litres "
    b"gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds "
    b"percent degree degrees celsius fahrenheit kelvin mph kph meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters watt watts kw kwh volt volts "
    b"ampere amperes joule joules newton newtons pascal hz khz mhz ghz kb mb gb tb piece pieces item items dozen".split())
_STRIP = b".,;:!?\"'()[]{}<>*_`"
_ENDS = b".!?:"
NUM, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x, 7) & ~15) for x in (b"<num>", b"<name>", b"<unit>"))
#: Of a token that is punctuation only.
NO_WORD = np.uint64(xxhash.xxh64_intdigest(b"", 7) & ~15)
_ODD = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


class _Tokens(dict):
    """Of a raw word: its hash with four flags below: number 1, capital 2, ends a sentence 4, unit 8."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word = raw.strip(_STRIP)
        low = word.lower()
        flags = 1 * bool(NUMBER.fullmatch(word)) | 2 * (word[:1].isupper()) | 4 * (raw.rstrip(b"\"')]")[-1:] in _ENDS and raw != b"") | 8 * (low in UNITS)
        h = self[raw] = (xxhash.xxh64_intdigest(low, 7) & ~15) | flags
        return h

    def template(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of lower-case words, and of the template: placeholders for numbers, capitals within a sentence and units after a number."""
        a = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        f = (a & np.uint64(15)).astype(np.uint8)
        plain = a & np.uint64(0xFFFFFFFFFFFFFFF0)
        h = plain.copy()
        number, inside = (f & 1) > 0, np.zeros(len(a), bool)
        after_number = np.zeros(len(a), bool)
        inside[1:] = (f[:-1] & 4) == 0
        after_number[1:] = number[:-1]
        h[((f & 2) > 0) & inside & ~number] = NAME
        h[((f & 8) > 0) & after_number] = UNIT
        h[number] = NUM
        return plain, h


def _hashes(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    out = h[:m] * _ODD[0]
    for j in range(1, n):
        out += h[j:j + m] * _ODD[j]
    return out


def _slot(h: np.uint64) -> bool:
    return h in (NUM, NAME, UNIT)


@dataclass
class Index:
    """Windows of benchmark items by kind (1 template, 0 words) and length: sorted hashes with item and place; the items' words and slots."""

    windows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    words: list[list[bytes]]
    slots: list[np.ndarray]
    ids: list[int]


def build_index(items: list[tuple[int, str]]) -> Index:
    """Index of (item id, text); null texts and texts without words have no window.

    A template without placeholders is left to the windows of words, which match wherever it would.
    """
    tokens, words, slots, found = _Tokens(), [], [], defaultdict(list)
    for k, (_, text) in enumerate(items):
        w = (text or "").encode().split()
        plain, h = tokens.template(w)
        slot = np.isin(h, np.array([NUM, NAME, UNIT]))
        words.append(w)
        slots.append(slot)
        n = min(len(w), WINDOW)
        if n == 0:
            continue
        for place, x in enumerate(_hashes(plain, n)):
            if (plain[place:place + n] != NO_WORD).any():
                found[0, n].append((int(x), k, place))
        if n >= LEAST:
            for place, x in enumerate(_hashes(h, n)):
                if slot[place:place + n].any() and (~slot[place:place + n]).sum() >= LITERAL * n:
                    found[1, n].append((int(x), k, place))
    windows = {}
    for n, rows in found.items():
        rows.sort()
        windows[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Index(windows, words, slots, [i for i, _ in items])


def leaks(text: str | None, index: Index, tokens: _Tokens) -> list[dict]:
    """Items of which a text holds enough, each with its coverage, kind and first word."""
    words = (text or "").encode().split()
    if not words:
        return []
    hashes = tokens.template(words)
    hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for (kind, n), (keys, item, place) in index.windows.items():
        if len(words) < n:
            continue
        x = _hashes(hashes[kind], n)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        for i in np.flatnonzero(keys[at] == x).tolist():
            k = int(at[i])
            while k < len(keys) and keys[k] == x[i]:
                hits[int(item[k])].update((int(place[k]) + j, i + j) for j in range(n))
                k += 1
    out = []
    for k, pairs in sorted(hits.items()):
        by_shift: dict[int, list[int]] = defaultdict(list)
        for a, b in pairs:
            by_shift[b - a].append(a)
        # an alignment counts if the values behind its placeholders map consistently, one of the item to one of the document
        exact, loose = {}, {}
        for shift, places in by_shift.items():
            same = _consistent(index.words[k], index.slots[k], words, shift, places)
            if same is not None:
                loose[shift] = places
                if same:
                    exact[shift] = places
        for kind, chosen in (("exact", exact), ("reparameterised", loose)):
            covered = sorted({a for places in chosen.values() for a in places})
            if _enough(covered, len(index.words[k])):
                out.append({"item_id": index.ids[k], "covered": len(covered), "item_words": len(index.words[k]), "kind": kind, "first_word": min(min(p) + s for s, p in chosen.items())})
                break
    return out


def _enough(covered: list[int], n: int) -> bool:
    """Is a large part of an item's places covered, or enough of them in a row?"""
    run = best = 0
    last = None
    for a in covered:
        run = run + 1 if last == a - 1 else 1
        best, last = max(best, run), a
    return bool(covered) and (best >= min(RUN, n) or len(covered) >= COVER * n)


def _consistent(own: list[bytes], slot: np.ndarray, words: list[bytes], shift: int, places: list[int]) -> bool | None:
    """Are an alignment's values the same (true), others that map consistently (false), or neither (none)?"""
    to: dict[bytes, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    total = same = 0
    for a in places:
        if slot[a]:
            v, w = own[a].strip(_STRIP).lower(), words[a + shift].strip(_STRIP).lower()
            to[v][w] += 1
            total += 1
            same += v == w
    if total == same:
        return True
    return False if total - sum(max(c.values()) for c in to.values()) <= LOOSE * total else None


def _parts(benchmark: DataFrame, id_col: str, text_col: str, max_windows: int) -> list[Index]:
    """Indexes of the benchmark, none with more windows than stated (or one item)."""
    parts, held, size = [], [], 0
    for r in pick(benchmark, id_col, text_col).toDF("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = 2 * len((r.text or "").split())
        if held and size + n > max_windows:
            parts.append(build_index(held))
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    return [*parts, build_index(held)] if held else []


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document and item it leaks: covered and item_words, kind (exact or reparameterised), first_word.

    Null and empty texts leak nothing, nor do null items; an empty benchmark or table gives no row.
    Repeated rows give repeated results; a benchmark larger than ``max_windows`` is gone through in
    parts; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    out = None
    schema = "doc_id long, item_id long, covered long, item_words long, kind string, first_word long"
    for index in _parts(benchmark, item_col, item_text_col, max_windows):
        sent = spark.sparkContext.broadcast(index)  # at most max_windows windows

        def start(sent=sent):
            tokens = _Tokens()
            return lambda doc, text: ((doc, x["item_id"], x["covered"], x["item_words"], x["kind"], x["first_word"]) for x in leaks(text, sent.value, tokens))

        found = map_rows(pick(docs, id_col, text_col), start, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents that leak no item, with all of their columns."""
    spark = docs.sparkSession
    ship(spark)
    for index in _parts(benchmark, item_col, item_text_col, max_windows):
        sent = spark.sparkContext.broadcast(index)  # at most max_windows windows

        def start(sent=sent):
            tokens = _Tokens()
            return lambda texts: [not leaks(t, sent.value, tokens) for t in texts]

        docs = keep_rows(docs, text_col, start)
    return docs
