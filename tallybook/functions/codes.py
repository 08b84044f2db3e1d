"""Barcodes, customs codes and serial numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_only(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")


def gtin_valid(code: Column, lengths: tuple[int, ...] = (8, 12, 13, 14)) -> Column:
    """Whether a code of one of the lengths ends in its check digit: weights 3 and 1 in turn from the right."""
    figures = F.transform(F.split(F.reverse(code), ""), lambda c: c.try_cast("int"))
    weighed = F.transform(figures, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(weighed, F.lit(0), lambda acc, v: acc + v)
    return code.rlike("^[0-9]+$") & F.length(code).isin(*lengths) & F.coalesce(total % 10 == 0, F.lit(False))


def ean8_valid(code: Column) -> Column:
    return gtin_valid(code, (8,))


def ean_checksum_ok(s: Column) -> Column:
    """Whether a text's digits are an EAN of 8, 13 or 14 digits with a right check digit."""
    return gtin_valid(digits_only(s), (8, 13, 14))


def upc_as_ean13(s: Column) -> Column:
    """A UPC-A's twelve digits with a zero before, where its check digit is right; null else."""
    d = digits_only(s)
    return F.when(gtin_valid(d, (12,)), F.concat(F.lit("0"), d))


def check_digit(body: Column) -> Column:
    """The check digit of a code without it."""
    figures = F.transform(F.split(F.reverse(body), ""), lambda c: c.try_cast("int"))
    weighed = F.transform(figures, lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1))
    return (10 - F.aggregate(weighed, F.lit(0), lambda acc, v: acc + v) % 10) % 10


def barcode_kind(code: Column) -> Column:
    """The kind of a code by its number of digits, and whether it is valid."""
    d = digits_only(code)
    n = F.length(d)
    kind = F.when(n == 8, "EAN-8").when(n == 12, "UPC-A").when(n == 13, "EAN-13").when(n == 14, "GTIN-14").otherwise("unknown")
    return F.struct(kind.alias("kind"), gtin_valid(d).alias("valid"))


def clean_ean(s: Column) -> Column:
    d = digits_only(s)
    return F.when(F.length(d).isin(8, 13, 14), d).otherwise("")


def padded_ean(s: Column) -> Column:
    """13 digits: shorter codes padded with zeros, 14 with a leading zero cut."""
    d = digits_only(s)
    return F.when((F.length(d) == 14) & d.startswith("0"), F.substring(d, 2, 13)).when(F.length(d) < 13, F.lpad(d, 13, "0")).otherwise(d)


def ean13_of(s: Column) -> Column:
    """12 digits with a zero before, 14 without their leading zero, others as they are."""
    d = digits_only(s)
    return F.when(F.length(d) == 12, F.concat(F.lit("0"), d)).when((F.length(d) == 14) & d.startswith("0"), F.substring(d, 2, 13)).otherwise(d)


def customs_code_check(raw: Column) -> Column:
    """(status, reason) of a customs code's structure."""
    d, letters = digits_only(raw), F.regexp_replace(F.coalesce(raw, F.lit("")), r"[0-9\s.\-]", "")
    chapter = F.substring(d, 1, 2)
    status = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "warning").when(letters != "", "error").when(~F.length(d).isin(6, 8, 10), "error").when(chapter == "00", "error").when(chapter.isin("77", "98", "99"), "warning").otherwise("ok")
    reason = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "missing").when(letters != "", "characters").when(~F.length(d).isin(6, 8, 10), "length").when(chapter == "00", "chapter 00").when(status == "warning", "reserved chapter").otherwise("")
    return F.struct(status.alias("status"), reason.alias("reason"))


def customs_codes_agree(a: Column, b: Column, least: int = 8) -> Column:
    """same, prefix (equal on the shorter one's digits, eight at least), missing or different."""
    x, y = digits_only(a), digits_only(b)
    n = F.least(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), "missing").when(x == y, "same").when((n >= least) & (F.substr(x, F.lit(1), n) == F.substr(y, F.lit(1), n)), "prefix").otherwise("different")


def gs1_bracketed(raw: Column) -> Column:
    """A map from application identifiers in brackets to their values; a repeated one keeps its last."""
    marks = F.regexp_extract_all(raw, F.lit(r"(\([0-9]{2,4}\)[^(]+)"), F.lit(1))
    pairs = F.transform(marks, lambda m: F.struct(F.regexp_extract(m, r"^\(([0-9]+)\)", 1).alias("key"), F.trim(F.regexp_replace(m, r"^\([0-9]+\)", "")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: ~F.exists(F.slice(pairs, F.array_position(pairs, p).cast("int") + 1, F.size(pairs)), lambda q: q["key"] == p["key"])))


def gs1_missing(found: Column, mandatory: tuple[str, ...] = ("01", "17", "10")) -> Column:
    return F.array_except(F.array(*map(F.lit, mandatory)), F.map_keys(found))
