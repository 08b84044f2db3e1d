"""Numbers written in mixed local formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"
#: Typical rates of exchange that a ratio of two amounts is held against.
TYPICAL_RATES = (3.8, 3.9, 4.0, 4.1, 4.2, 4.3, 4.4, 4.5, 4.6, 5.0)
#: Dashes that count as a minus sign (fixed values).
DASHES = "‐‑‒–—−"


def plain_dashes(s: Column) -> Column:
    return F.translate(s, DASHES, "-" * len(DASHES))


def _occurrences(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def _without(s: Column, char: str) -> Column:
    return F.replace(s, F.lit(char), F.lit(""))


def parse_number(s: Column) -> Column:
    """A decimal from 13,500.00 / 13.500,00 / 13 500,00 / 1.234 (thousands) / 1.5e3; null if it is none.

    One separator followed by exactly three digits, after a whole part other than 0, marks thousands.
    Ranges, over 50 characters, over three of a separator, letters and per cent signs give null, and so do
    NaN and infinities.
    """
    trimmed = F.trim(plain_dashes(s))
    clean = F.regexp_replace(trimmed, r"[€$£¥\s]", "")
    dots, commas = _occurrences(clean, "."), _occurrences(clean, ",")
    dot_last = F.length(F.substring_index(clean, ".", -1)) < F.length(F.substring_index(clean, ",", -1))
    thousands = clean.rlike(r"^-*(?!0[.,])[0-9]+[.,][0-9]{3}$")
    digits = (
        F.when((dots == 0) & (commas == 0), clean)
        .when(dots + commas == 1, F.when(thousands, F.translate(clean, ".,", "")).otherwise(F.translate(clean, ",", ".")))
        .when(commas == 0, _without(clean, "."))
        .when(dots == 0, _without(clean, ","))
        .when((dots == 1) & dot_last, _without(clean, ","))
        .when((dots == 1) | (commas == 1), F.translate(_without(clean, "."), ",", "."))
    )
    fit = (F.length(trimmed) <= 50) & ~trimmed.rlike(r"[0-9][,.][0-9][0-9.,]*-[0-9]") & (dots <= 3) & (commas <= 3) & digits.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(trimmed.rlike(r"^[-+]?[0-9]+\.?[0-9]*[eE][-+]?[0-9]+$"), trimmed.try_cast("double").try_cast(NUMBER)).when(fit, digits.try_cast(NUMBER))


def numbers_equal(a: Column, b: Column, tolerance_pct: float = 0.0) -> Column:
    """Of parsed numbers: null if one is missing; near zero an absolute bound of 0.0001, else a share of the larger."""
    gap, larger = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    near = (gap * 100 <= larger * F.lit(tolerance_pct).cast("decimal(10,4)")) if tolerance_pct > 0 else F.lit(False)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, True).when((a == 0) | (b == 0), gap <= F.lit("0.0001").cast(NUMBER)).otherwise(near)


def differ_only_by_rounding(a: Column, b: Column, places: int = 2) -> Column:
    """Equal after rounding half up; false if one is missing."""
    places = max(0, min(10, places))
    return F.coalesce(F.round(a, places) == F.round(b, places), F.lit(False))


def without_letters(s: Column) -> Column:
    """The text without letters and blanks: what is left of amounts with units."""
    return F.regexp_replace(s, r"[\p{L}\s]+", "")


def parse_amount(s: Column, places: int = 4) -> Column:
    """A number beside letters (12 USD), rounded."""
    return F.round(parse_number(without_letters(s)), places)


def parse_stock_number(s: Column) -> Column:
    """Where a single comma or dot is always decimal; of both the last one is."""
    clean = F.regexp_replace(s, r"[\s ]", "")
    comma_last = F.length(F.substring_index(clean, ",", -1)) < F.length(F.substring_index(clean, ".", -1))
    both = clean.contains(",") & clean.contains(".")
    digits = F.when(both & comma_last, F.translate(_without(clean, "."), ",", ".")).when(both, _without(clean, ",")).otherwise(F.translate(clean, ",", "."))
    return digits.try_cast(NUMBER)


def number_change(a: Column, b: Column) -> Column:
    """(difference, per cent of the first) of parsed numbers; per cent is null where the first is zero."""
    return F.struct((b - a).cast("decimal(28,10)").alias("delta"), F.when(a != 0, F.round((b - a) / F.abs(a) * 100, 1).cast("decimal(18,1)")).alias("pct"))


def typical_rate(a: Column, b: Column, margin: float = 0.15) -> Column:
    """The first typical rate within ``margin`` of the larger amount over the smaller, or null; ratios of 100 and more are none."""
    ratio = F.greatest(a, b).cast("double") / F.nullif(F.least(a, b).cast("double"), F.lit(0.0))
    return F.when((ratio > 1) & (ratio < 100), F.get(F.filter(F.array(*map(F.lit, TYPICAL_RATES)), lambda r: F.abs(ratio - r) < margin), F.lit(0)))


def numbers_in(text: Column) -> Column:
    """All numbers in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]+(?:[.,][0-9]+)*)"), F.lit(1)), parse_number)


def lists_differ(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Whether two lists of numbers differ in length or somewhere by more than the tolerance."""
    far = F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > F.lit(tolerance).cast(NUMBER)), lambda x: F.coalesce(x, F.lit(True)))
    return (F.size(a) != F.size(b)) | far


def distinctive(v: Column) -> Column:
    """Numbers that tell something: of ten or more, or with a fraction."""
    return (F.abs(v) >= 10) | (v != F.floor(v))


def vat_code(s: Column) -> Column:
    """23% and 23,0 as 23; exemptions in lower case without dots; other texts as their first ten characters."""
    t = F.trim(F.translate(F.lower(F.trim(F.coalesce(s, F.lit("")))), ",%", "."))
    rate = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(t.isin("zw", "zw.", "zwolniony", "np", "n/p", "np."), F.replace(t, F.lit("."), F.lit(""))).when(rate != "", F.substring(F.regexp_replace(rate, r"\.0$", ""), 1, 10)).otherwise(F.substring(t, 1, 10))


def truthy(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s.cast("string"))).isin("1", "tak", "t", "yes", "y", "x", "true", "sent", "prawda"), F.lit(False)).cast("int")


def roman(s: Column) -> Column:
    """A roman numeral's value: a digit before a larger one is taken away."""
    worth = F.create_map(*(F.lit(x) for p in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in p))
    values = F.transform(F.split(F.upper(s), ""), lambda c: F.coalesce(F.try_element_at(worth, c), F.lit(0)))
    back = F.aggregate(F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))
    return back["sum"]


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """Cost of a model call: tokens times price per million, with a default price."""
    price_in, price_out = (F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for m, p in prices.items() for x in (m, str(p[k])))), model), F.lit(str(default[k]))).cast("decimal(18,6)") for k in (0, 1))
    return ((tokens_in * price_in + tokens_out * price_out) / 1_000_000).cast("decimal(18,6)")


def safe_cell(s: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), s)).otherwise(s)
