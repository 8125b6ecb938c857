"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tabwise.functions import fixed as V

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def q(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str, dt: T.DataType) -> Column:
    """Canonical text of a value: NaN counts as missing and -0.0 equals 0.0."""
    c = q(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c + F.lit(0.0))
    return c.cast("string")


def as_double(name: str, dt: T.DataType | None = None) -> Column:
    """Numeric value with NaN folded into NULL; unparseable text becomes NULL."""
    c = q(name)
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def strip_number(c: Column) -> Column:
    """Number from text: currency signs, percent signs and thousands commas removed."""
    t = F.trim(F.regexp_replace(c.cast("string"), V.NUMBER_NOISE, ""))
    d = t.try_cast("double")  # would also read Java literals such as "1d" or "2f"
    return F.when(~F.isnan(d) & ~t.rlike("[dDfF]$"), d)


def parse_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(V.BOOL_TRUE), F.lit(True)).when(t.isin(V.BOOL_FALSE), F.lit(False))


def normalize_category(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(~t.isin("nan", "None"), t)


def is_blank(c: Column) -> Column:
    """Missing for categorical imputation: NULL, blank, or the words nan / none."""
    s = c.cast("string")
    return c.isNull() | (F.trim(s) == "") | F.lower(s).isin("nan", "none")


def na_to_null(c: Column) -> Column:
    """Fold the usual missing-value tokens of delimited files into NULL."""
    return F.when(~F.trim(c).isin(V.NA_TOKENS), c)


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, 0 where the whole is empty."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale), F.lit(0.0))


# --- moments ----------------------------------------------------------------

def sample_skewness(c: Column, n: Column) -> Column:
    """Bias-corrected skewness; 0 where it is undefined (n <= 2 or constant data)."""
    n = n.cast("double")
    g = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(c))
    return F.coalesce(g, F.lit(0.0))


def sample_kurtosis(c: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 where it is undefined (n <= 3 or constant data)."""
    n = n.cast("double")
    g = F.when(
        n > 3,
        (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6),
    )
    return F.coalesce(g, F.lit(0.0))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over complete pairs; NULL where either side has no variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


# --- ordered arrays -----------------------------------------------------------

def count_at_most(
    sorted_array: Column, x: Column, size: Column | None = None, bound: int = 1 << 24
) -> Column:
    """How many elements of a sorted array are <= x, by binary search.

    A walk over falling powers of two: each step tests one element, so the cost is
    the logarithm of the array length instead of its length.  ``bound`` is the longest
    array that can occur.
    """
    size = F.size(sorted_array) if size is None else size
    steps = F.array(*[F.lit(1 << k) for k in range(max(bound, 1).bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= size) & (F.get(sorted_array, at + step - 1) <= x), at + step
        ).otherwise(at),
    )


# --- masking --------------------------------------------------------------------

def mask_text(c: Column, pii_type: str | None = None) -> Column:
    """Masked text of one value; ``pii_type`` masks the whole column.

    The cheap tests ("has an @", "has three digits") let most texts skip the regexes.
    """
    text = F.trim(c.cast("string"))
    if pii_type is not None:
        return F.when(c.isNull(), "<NULL>").otherwise(F.lit(f"[REDACTED_{(pii_type or 'PII').upper()}]"))
    digits = text.rlike(r"\d{3}")
    return (
        F.when(c.isNull(), "<NULL>")
        .when(text.contains("@") & text.rlike(V.EMAIL_SEARCH), "[REDACTED_EMAIL]")
        .when(digits & text.rlike(V.PHONE_SEARCH), "[REDACTED_PHONE]")
        .when(digits & text.rlike(V.CARD_SEARCH), "[REDACTED_CREDIT_CARD]")
        .when(digits & text.rlike(V.SSN_SEARCH), "[REDACTED_SSN]")
        .otherwise(text)
    )


def redact_secrets(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(c, V.SECRET_PAIR, "$1: [REDACTED]"), V.SECRET_KEY, "[REDACTED_API_KEY]"
    )


# --- numbers in text ------------------------------------------------------------

def numbers_in(c: Column) -> Column:
    """All numbers of a text as array<double>; fixed "/100" scales do not count."""
    found = F.regexp_extract_all(F.regexp_replace(c, V.SCALE_SUFFIX, ""), F.lit(V.NUMBER), 0)
    parsed = F.transform(found, lambda m: F.regexp_replace(m, "[,%]", "").try_cast("double"))
    return F.filter(parsed, lambda d: d.isNotNull() & (F.abs(d) < F.lit(float("inf"))))


# --- headers --------------------------------------------------------------------

def pii_by_header(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, rule in reversed(V.PII_HEADER_RULES):
        out = F.when(F.trim(name).rlike(rule), kind).otherwise(out)
    return out


def label_by_header(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, rule in reversed(V.LABEL_RULES):
        out = F.when(F.trim(name).rlike(rule), label).otherwise(out)
    return out


def is_post_outcome(name: Column) -> Column:
    hit = F.lit(False)
    for rule in V.POST_OUTCOME:
        hit = hit | F.lower(name).rlike(rule)
    return hit


def shielded_by_header(name: Column) -> Column:
    hit = F.lit(False)
    for rule in V.SHIELD_HEADERS:
        hit = hit | F.trim(name).rlike(rule)
    return hit


def shielded(name: Column, is_pii: Column, label: Column, pii_type: Column) -> Column:
    """A column nobody may ask about: flagged, labelled or merely named like personal data."""
    return (
        F.coalesce(is_pii, F.lit(False))
        | F.coalesce(label.isin(V.SHIELD_LABELS), F.lit(False))
        | F.coalesce(~F.lower(pii_type).isin("none", "", "null"), F.lit(False))
        | shielded_by_header(name)
    )


def kept_out_of_evidence(name: Column, is_pii: Column, label: Column, pii_type: Column) -> Column:
    return (
        F.coalesce(is_pii, F.lit(False))
        | F.coalesce(F.lower(F.trim(label)).isin(V.EVIDENCE_LABELS), F.lit(False))
        | F.coalesce(~F.lower(F.trim(pii_type)).isin("none", ""), F.lit(False))
        | F.trim(name).rlike(V.EVIDENCE_HEADER)
    )


def screen_message(c: Column) -> Column:
    """Name of the first screening family a message falls into, else NULL."""
    low = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for family, rule in reversed(V.MESSAGE_SCREEN):
        out = F.when(low.rlike("(?U)" + rule), family).otherwise(out)
    return out
