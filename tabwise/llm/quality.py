"""Quality rules, line first, in DataFrame expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed and
a document that loses too large a part of its words is rejected.  Counts over the whole text (symbols,
repeated lines, words in repeated three-word windows) stand beside the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import once
from .common import SPACES, pick

#: Part of the words a document may lose with its failing lines.
MOST_LOST = 0.4
#: Lines of at most so many words need an end mark.
SHORT_LINE = 4
#: A line with a higher part of symbols among its characters fails.
MOST_SYMBOLS = 0.15
#: A boilerplate phrase condemns a line of at most so many characters.
BOILERPLATE_CHARS = 120

SYMBOLS = r"[#*$%&|<>]"
END_MARKS = ".!?:;,…。！？\"'”’»)]}"
NAVIGATION = r"^[^|»›>]*(?:[|»›>][^|»›>]{0,60}){3,}$"
BOILERPLATE = (
    r"(?i)(?:skip to (?:main )?content|sign in|log ?in|sign up|subscribe (?:now|to)|accept (?:all )?cookies|cookie (?:policy|settings)|privacy policy|"
    r"terms of (?:use|service)|all rights reserved|click here|read more|share (?:this|on)|follow us|enable javascript|back to top|lorem ipsum)\b"
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACES), F.lit(0))


def line_verdict(line: Column) -> Column:
    """The rule a line breaks, null where it stays.  Lines without a word stay; cheap tests come first."""
    n = F.regexp_count(line, F.lit(SPACES))
    marked = line.contains("|") | line.contains("»") | line.contains("›") | line.contains(">")
    odd = F.length(line) - F.length(F.translate(line, "#*$%&|<>", ""))
    last = F.right(F.rtrim(line, F.lit(" \t\r\x0b\x0c")), F.lit(1))
    return (
        F.when(marked & line.rlike(NAVIGATION), "navigation")
        .when(odd > MOST_SYMBOLS * F.length(line), "symbols")
        .when((F.length(line) <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE), "boilerplate")
        .when(~last.isin(*END_MARKS) & n.between(1, SHORT_LINE), "punctuation")
    )


def window_keys(words: Column, n: Column, bits: Column) -> Column:
    """One sorted number per window of three words: hash bits above, place below."""
    def key(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        high = F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
        return high.bitwiseOR(i.cast("long"))

    return F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key)))


def repeated_places(words: Column, keys: Column, bits: Column) -> tuple[Column, Column]:
    """Windows whose hash bits have company, sorted by their words; the places of those that truly occur twice.

    The second takes the first as a column named ``windows``."""
    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def at(x: Column) -> Column:
        return (x - F.call_function("shiftleft", high(x), bits)).cast("int")

    near = F.filter(keys, lambda x, i: F.coalesce((high(x) == high(F.get(keys, i + 1))) | (high(x) == high(F.get(keys, i - 1))), F.lit(False)))
    windows = F.sort_array(F.transform(near, lambda x: F.struct(
        F.struct(F.get(words, at(x)), F.get(words, at(x) + 1), F.get(words, at(x) + 2)).alias("w"), at(x).alias("at"))))
    s = F.col("windows")
    again = F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)))
    return windows, F.transform(again, lambda x: x["at"])


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """One row per document: counts, verdict and the text that is left.

    Null text counts as empty: all counts zero, base_failed true, kept false, cleaned text empty.
    Equal lines count from the second on; lines without a word never count as repeats.  Repeated rows
    give repeated results, an empty table an empty one; other columns are not looked at.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = once(d, F.struct(words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines")))
    d = d.withColumn("n", F.size("words")).withColumn("bits", (F.ceil(F.log2(F.greatest("n", F.lit(1)))) + 1).cast("int"))
    keys = window_keys(F.col("words"), F.col("n"), F.col("bits"))
    full = F.filter("lines", lambda x: x.rlike(SPACES))
    lost = F.filter("lines", lambda x: line_verdict(x).isNotNull())
    d = once(d, F.struct(keys.alias("keys"), full.alias("full"), lost.alias("lost")))
    windows, again = repeated_places(F.col("words"), F.col("keys"), F.col("bits"))
    d = once(d, F.struct(windows.alias("windows")))
    d = once(d, F.struct(again.alias("again")))
    covered = F.array_union(F.array_union("again", F.transform("again", lambda p: p + 1)), F.transform("again", lambda p: p + 2))
    left = F.when(F.size("lost") == 0, F.col("text")).otherwise(F.array_join(F.filter("lines", lambda x: ~F.array_contains("lost", x)), "\n"))
    d = d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        F.aggregate("lost", F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(SPACES))).alias("n_lost_words"), left.alias("cleaned"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= most_lost * F.col("n_words")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", "cleaned")
