"""Column expressions: keys, dates, text, ratios and labels.

All of them stay inside Catalyst, so they run in generated code next to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped from surrogate keys.
KEY_NOISE = r"[\s,.\-_]+"

# Every character a Unicode-aware \s matches, spelled out so that Java's
# ASCII-only \s cannot change where a URL ends.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL = rf"(?:http|www)[^{WHITESPACE}]+"
NOT_WORD = r"[^a-z0-9']+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- keys and names -------------------------------------------------------


def compact_key(*parts: Column | str) -> Column:
    """Join the parts and drop spaces, commas, dots, dashes and underscores.

    NULL in any part gives a NULL key instead of the text "None".
    """
    return F.regexp_replace(F.concat(*[as_column(p) for p in parts]), KEY_NOISE, "")


def without_spaces(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), r"\s+", "")


def category_key(c: Column | str) -> Column:
    """Comparable spelling of a category: trimmed, lower case, ``&`` as ``and``."""
    spelled = F.replace(F.lower(F.trim(as_column(c))), F.lit("&"), F.lit("and"))
    return F.regexp_replace(F.replace(spelled, F.lit(","), F.lit("")), r"\s+", " ")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def finite_or_null(c: Column | str) -> Column:
    """NaN and both infinities become NULL; other values pass."""
    x = as_column(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


# --- coercion -------------------------------------------------------------


DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd.MM.yyyy")


def to_date_or_null(c: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """The date by Spark's own cast, else by the first format that fits; times of day are left out."""
    text = F.trim(as_column(c).cast("string"))
    day = F.split(text, "[ T]")[0]
    return F.coalesce(F.try_to_date(text), *[F.try_to_date(day, f) for f in formats])


def to_money_or_null(c: Column | str) -> Column:
    return as_column(c).try_cast("decimal(18,2)")


def to_int_or_null(c: Column | str) -> Column:
    """Whole numbers, also written with a decimal point; a fraction is cut off."""
    return as_column(c).try_cast("decimal(38,10)").try_cast("int")


def to_bigint_or_null(c: Column | str) -> Column:
    return as_column(c).try_cast("decimal(38,10)").try_cast("bigint")


def epoch_to_date(seconds: Column | str, origin: str = "1970-01-01") -> Column:
    """Date ``seconds`` after ``origin``, by whole days so no time zone matters."""
    days = F.floor(as_column(seconds).cast("bigint") / F.lit(86400)).cast("int")
    return F.date_add(F.lit(origin).cast("date"), days)


# --- dates ----------------------------------------------------------------


def month_start(c: Column | str) -> Column:
    return F.trunc(as_column(c), "MM")


def month_name(c: Column | str) -> Column:
    return F.date_format(as_column(c), "MMMM")


def year_month(c: Column | str) -> Column:
    return F.date_format(as_column(c), "yyyy-MM")


def rebase_year(c: Column | str, years: Iterable[int], target: int) -> Column:
    """Move dates of ``years`` to ``target``; 29 February becomes 28 February."""
    d = as_column(c)
    moved = F.add_months(d, (F.lit(target) - F.year(d)) * 12)
    return F.when(F.year(d).isin(list(years)), moved).otherwise(d)


def season(month_number: Column | str) -> Column:
    m = as_column(month_number)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


# --- numbers --------------------------------------------------------------


def half_even(c: Column | str, places: int) -> Column:
    """Round a DOUBLE half to even the way array libraries do: scale, rint, scale back."""
    scale = F.lit(10.0**places)
    return F.rint(as_column(c).cast("double") * scale) / scale


def money(c: Column | str) -> Column:
    """A DECIMAL total leaves the job as DOUBLE; it was summed exactly."""
    return as_column(c).cast("double")


def money2(c: Column | str) -> Column:
    return F.round(as_column(c), 2).cast("double")


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE; NULL when either side is NULL or den is 0."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def percent_of(part: Column | str, whole: Column | str, places: int = 2) -> Column:
    share = F.try_divide(
        as_column(part).cast("double") * F.lit(100.0), as_column(whole).cast("double")
    )
    return half_even(share, places)


def growth_ratio(current: Column | str, previous: Column | str) -> Column:
    c, p = as_column(current).cast("double"), as_column(previous).cast("double")
    return F.try_divide(c - p, p)


def growth_percent(current: Column | str, previous: Column | str, places: int = 2) -> Column:
    """(current - previous) / previous in percent; NULL without a base."""
    return half_even(growth_ratio(current, previous) * 100.0, places)


# --- labels ---------------------------------------------------------------


def trend_label(pct: Column | str) -> Column:
    p = as_column(pct)
    return (
        F.when(p.isNull(), "N/A")
        .when(p >= 5, "Upward")
        .when(p > 0, "Slight Upward")
        .when(p <= -5, "Declining")
        .when(p < 0, "Slight Decline")
        .otherwise("Flat")
    )


def sentiment_label(score: Column | str) -> Column:
    s = as_column(score)
    return F.when(s > 0.05, "Positive").when(s < -0.05, "Negative").otherwise("Neutral")


# --- text -----------------------------------------------------------------


def without_urls(c: Column | str) -> Column:
    """Lower case without URLs."""
    low = F.lower(as_column(c))
    # Most texts hold no URL: a plain substring search spares them the pattern.
    linked = F.contains(low, F.lit("http")) | F.contains(low, F.lit("www"))
    return F.when(linked, F.regexp_replace(low, URL, " ")).otherwise(low)


def clean_text(c: Column | str) -> Column:
    """Lower case, no URLs, only letters, digits and apostrophes, single spaces."""
    return F.coalesce(F.trim(F.regexp_replace(without_urls(c), NOT_WORD, " ")), F.lit(""))


def tokens_of(clean: Column | str) -> Column:
    """Words of an already cleaned text; the empty text has none."""
    text = as_column(clean)
    return F.when(text != "", F.split(text, " ")).otherwise(F.array().cast("array<string>"))
