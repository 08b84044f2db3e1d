"""Barcodes of application identifiers (AI) and values: bracketed, run together, or mixed.

Run together, a code can only be read from the left, each field ending where the rules of its identifier say. These
rules make one regular expression, built from the table below, whose matches follow each other without a
gap: the fields come out in the JVM, by one pass over each code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import digits_only, gtin_valid
from .dates import gs1_date

#: Identifiers whose value has always so many characters, and those whose value has at most so many.
FIXED = {"00": 18, "01": 14, "02": 14, "11": 6, "13": 6, "15": 6, "17": 6, "20": 2, "310": 6, "320": 6, "330": 6, "410": 13}
UP_TO = {"10": 20, "21": 20, "22": 29, "30": 8, "37": 8, "240": 30, "241": 30, "400": 30, "401": 30, "420": 20, "710": 30, "711": 30, "713": 30}
DATES = ("11", "13", "15", "17")
MANDATORY = ("01", "17", "10")

_GS = "\\x1d"
_KEYS = "|".join(sorted({**FIXED, **UP_TO}, key=lambda k: (-len(k), k)))
_WHOLE_FIXED = "|".join(f"{k}.{{{n}}}" for k, n in FIXED.items())
# Where a field without separator ends: an identifier, with room for its value if that is of fixed length.
_NEXT = f"(?:{_WHOLE_FIXED}|{'|'.join(UP_TO)})"


def _field(key: str) -> str:
    if key in FIXED:
        return f"{key}.{{0,{FIXED[key]}}}"
    n = UP_TO[key]
    return f"{key}(?:[^{_GS}]{{0,{n - 1}}}{_GS}|.{{1,{n}}}?(?={_NEXT})|.{{0,{n}}})"


_SCAN = rf"(?s)\G{_GS}*(?:{'|'.join(_field(k) for k in _KEYS.split('|'))})"
_MARK = r"(?s)\([0-9]{2,4}\)[^(]*"


def _plain(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def _of_bracketed(mark: Column) -> Column:
    return F.struct(F.regexp_extract(mark, r"^\(([0-9]+)\)", 1).alias("ai"), _plain(F.regexp_replace(mark, r"^\([0-9]+\)", "")).alias("value"))


def _of_scanned(piece: Column) -> Column:
    bare = F.regexp_replace(piece, f"^{_GS}+", "")
    key = F.regexp_extract(bare, f"^({_KEYS})", 1)
    value = F.regexp_replace(bare, f"^(?:{_KEYS})", "")
    return F.struct(key.alias("ai"), F.when(key.isin(*UP_TO), F.regexp_replace(value, f"{_GS}$", "")).otherwise(value).alias("value"))


def _bracketed(raw: Column, marks: Column) -> Column:
    """Whether the brackets tell all: nothing is outside them, and no value has swallowed a field that lacks its own."""
    lengths = F.aggregate(marks, F.lit(0), lambda n, m: n + F.length(m))
    begin = F.instr(raw, "(")
    fields = F.transform(marks, _of_bracketed)
    wrong = F.exists(fields, lambda f: f["ai"].isin(*FIXED) & (F.length(f["value"]) != F.coalesce(*(F.when(f["ai"] == k, n) for k, n in FIXED.items()))))
    glued = F.exists(fields, lambda f: f["ai"].isin(*UP_TO) & f["value"].rlike(f"(?s)^.+?(?:{_WHOLE_FIXED})$"))
    return (begin > 0) & (F.size(marks) > 0) & (lengths >= F.length(raw) - begin + 1) & ~wrong & ~glued


def read(raw: Column, today: Column) -> Column:
    """(fields array<(ai, value, parsed)>, gtin, lot, exp_date, prod_date, serial, gtin_valid, missing, errors) of a code.

    Blanks do not count. With brackets the fields are what stands between them, unless text stands outside, a
    value of fixed length has another one, or a value ends in an identifier and its whole value: then, and
    without brackets, the code is read from the left. There a value of fixed length takes its characters; another ends at
    a group separator (ASCII 29), else before the first identifier that leaves room for its own value, else at its
    greatest length or the end. Reading stops at an unknown identifier; in brackets such a field is left out.

    ``parsed`` is the date of a date field, else the value. Of a repeated field the last counts. ``errors``
    holds ``unknown:`` and the identifier (or the next four characters), ``date:`` and the identifier, and ``gtin``
    for a wrong check digit. ``missing`` lists the mandatory identifiers that have no field. Null gives null, and an empty code no field.
    """
    marks = F.regexp_extract_all(raw, F.lit(_MARK), F.lit(0))
    by_mark = F.transform(marks, _of_bracketed)
    run = _plain(F.when(F.instr(raw, "(") > 0, F.regexp_replace(raw, "[()]", "")).otherwise(raw))
    pieces = F.regexp_extract_all(run, F.lit(_SCAN), F.lit(0))
    read_to = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p))
    rest = F.regexp_replace(F.substr(run, read_to + 1), f"^{_GS}+", "")
    fast = _bracketed(raw, marks)
    fields = F.when(fast, F.filter(by_mark, lambda f: f["ai"].isin(*FIXED, *UP_TO))).otherwise(F.transform(pieces, _of_scanned))
    none = F.array().cast("array<string>")
    unknown = F.when(fast, F.transform(F.filter(by_mark, lambda f: ~f["ai"].isin(*FIXED, *UP_TO)), lambda f: F.concat(F.lit("unknown:"), f["ai"])))
    unknown = unknown.when(rest != "", F.array(F.concat(F.lit("unknown:"), F.substring(rest, 1, 4)))).otherwise(none)
    dated = F.transform(fields, lambda f: F.struct(f["ai"].alias("ai"), f["value"].alias("value"), F.when(f["ai"].isin(*DATES), gs1_date(f["value"], today).cast("string")).otherwise(f["value"]).alias("parsed")))
    wrong = F.transform(F.filter(dated, lambda f: f["parsed"].isNull()), lambda f: F.concat(F.lit("date:"), f["ai"]))
    full = F.transform(dated, lambda f: F.struct(f["ai"].alias("ai"), f["value"].alias("value"), F.coalesce(f["parsed"], f["value"]).alias("parsed")))
    last = lambda key: F.try_element_at(F.filter(full, lambda f: f["ai"] == key), F.lit(-1))
    gtin = last("01")["value"]
    valid = F.when(F.coalesce(gtin, F.lit("")) != "", gtin_valid(digits_only(gtin)))
    absent = F.array_except(F.array(*map(F.lit, MANDATORY)), F.transform(full, lambda f: f["ai"]))
    out = F.struct(
        full.alias("fields"), gtin.alias("gtin"), last("10")["value"].alias("lot"), last("17")["parsed"].alias("exp_date"), last("11")["parsed"].alias("prod_date"), last("21")["value"].alias("serial"),
        valid.alias("gtin_valid"), absent.alias("missing"), F.concat(unknown, wrong, F.when(~valid, F.array(F.lit("gtin"))).otherwise(none)).alias("errors"),
    )
    return F.when(raw.isNotNull(), out)
