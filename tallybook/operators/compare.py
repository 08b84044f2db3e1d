"""Comparison of two documents: line items, header fields, lines of text, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import dates_possibly_equal, parse_date
from ..functions.numbers import differ_only_by_rounding, numbers_equal, parse_number
from ..functions.similarity import token_sort_ratio
from ..functions.text import payment_terms

RISKS = ("error", "warning", "format", "ok")


def price_verdict(a: Column, b: Column, net_agrees: Column, places: int = 2, tolerance_pct: float = 0.0) -> Column:
    """Of two unit prices: ok, format (equal net, under half a per cent, or rounding), doubtful (under two per cent) or different."""
    gap, larger = F.abs(a - b), F.greatest(F.abs(a), F.abs(b), F.lit("0.0001").cast("decimal(18,4)"))
    equal = numbers_equal(a, b, tolerance_pct)
    small = (gap * 200 < larger) | differ_only_by_rounding(a, b, places)
    return F.when(equal.isNull() | equal, "ok").when(net_agrees | small, "format").when(gap * 50 < larger, "doubtful").otherwise("different")


def item_status(in_a: Column, in_b: Column, quantity_equal: Column, unit_equal: Column, price: Column, net: Column) -> Column:
    """A pair's status: a missing side, then any hard difference, then the first soft one in the order unit, price, net."""
    hard = F.coalesce(~quantity_equal, F.lit(False)) | (price == "different") | (net == "different")
    soft = F.when(~unit_equal, "doubtful").when(price != "ok", price).when(net != "ok", net).otherwise("ok")
    return F.when(~in_b, "missing in b").when(~in_a, "missing in a").when(hard, "different").otherwise(soft)


def compare_items(a: DataFrame, b: DataFrame, places: int = 2, each: bool = False) -> DataFrame:
    """(doc, ref, status, quantity_equal, unit_equal, price_verdict, net_verdict, arithmetic_ok) of items (doc, ref, qty, net, unit).

    Items pair by document and reference, in the order of their lines (if there is such a column), quantities
    and amounts: the second of a reference meets the other side's second. A null document or reference pairs
    with nothing. Units' prices are net over quantity. Both sides are shuffled once, together, on (doc, ref).
    With ``each``, every item meets every item of its reference on the other side, as an outer join does.
    """
    side = lambda t, s: t.select("doc", "ref", "qty", "net", "unit", F.when(F.col("qty") != 0, F.round(F.col("net") / F.col("qty"), 4)).alias("price"), (F.col("line") if "line" in t.columns else F.lit(None)).cast("long").alias("_line"), F.lit(s).alias("_side"))
    columns = ("qty", "net", "unit", "price")
    if each:
        left, right = (side(t, s).select("doc", "ref", *(F.col(c).alias(f"{c}_{s}") for c in columns), F.lit(True).alias(f"in_{s}")) for t, s in ((a, "a"), (b, "b")))
        m = left.join(right, ["doc", "ref"], "full").fillna(False, ["in_a", "in_b"])
    else:
        both = side(a, "a").union(side(b, "b")).repartition("doc", "ref")
        turn = F.row_number().over(Window.partitionBy("doc", "ref", "_side").orderBy("_line", "qty", "net", "unit"))
        alone = F.when(F.col("doc").isNull() | F.col("ref").isNull(), F.col("_side"))
        of = lambda c, s: F.max(F.when(F.col("_side") == s, F.col(c))).alias(f"{c}_{s}")
        m = both.withColumn("_turn", turn).withColumn("_alone", alone).groupBy("doc", "ref", "_turn", "_alone").agg(*(of(c, s) for s in "ab" for c in columns), *(F.bool_or(F.col("_side") == s).alias(f"in_{s}") for s in "ab"))
    net_agrees = F.coalesce(F.col("net_a") == F.col("net_b"), F.lit(False))
    price = price_verdict(F.col("price_a"), F.col("price_b"), net_agrees, places)
    net_equal = numbers_equal(F.col("net_a"), F.col("net_b"))
    net = F.when(net_equal.isNull() | net_equal, "ok").when(differ_only_by_rounding(F.col("net_a"), F.col("net_b"), places), "format").otherwise("different")
    quantity, unit = numbers_equal(F.col("qty_a"), F.col("qty_b")), F.coalesce(F.col("unit_a") == F.col("unit_b"), F.lit(True))
    worked = F.round(F.col("qty_b") * F.col("price_b"), 2)
    arithmetic = F.when((F.col("net_b") > 0) & (worked > 0), F.abs(worked - F.col("net_b")) * 50 <= F.col("net_b"))
    m = m.select("doc", "ref", "in_a", "in_b", quantity.alias("quantity_equal"), unit.alias("unit_equal"), price.alias("price_verdict"), net.alias("net_verdict"), arithmetic.alias("arithmetic_ok"))
    status = item_status(F.col("in_a"), F.col("in_b"), F.col("quantity_equal"), F.col("unit_equal"), F.col("price_verdict"), F.col("net_verdict"))
    return m.select("doc", "ref", status.alias("status"), "quantity_equal", "unit_equal", "price_verdict", "net_verdict", "arithmetic_ok")


def item_findings(compared: DataFrame) -> DataFrame:
    """(doc, ref, category, severity): one row for each finding of compared items."""
    c = F.col
    found = F.array(
        F.when(c("status").startswith("missing"), F.struct(F.lit("position").alias("category"), F.lit("error").alias("severity"))),
        F.when(~c("quantity_equal"), F.struct(F.lit("quantity").alias("category"), F.lit("error").alias("severity"))),
        F.when(~c("unit_equal") & ~c("status").startswith("missing"), F.struct(F.lit("unit").alias("category"), F.lit("warning").alias("severity"))),
        F.when((c("price_verdict") == "different") & ~c("status").startswith("missing"), F.struct(F.lit("price").alias("category"), F.lit("error").alias("severity"))),
        F.when((c("price_verdict") == "doubtful") & ~c("status").startswith("missing"), F.struct(F.lit("price").alias("category"), F.lit("warning").alias("severity"))),
        F.when((c("net_verdict") == "different") & ~c("status").startswith("missing"), F.struct(F.lit("value").alias("category"), F.lit("error").alias("severity"))),
        F.when(~c("arithmetic_ok"), F.struct(F.lit("arithmetic").alias("category"), F.lit("warning").alias("severity"))),
    )
    return compared.select("doc", "ref", F.explode(F.array_compact(found)).alias("f")).select("doc", "ref", "f.category", "f.severity")


def risk(errors: Column, warnings: Column, formats: Column) -> Column:
    return F.when(errors > 0, "error").when(warnings > 0, "warning").when(formats > 0, "format").otherwise("ok")


def compare_fields(a: DataFrame, b: DataFrame, keys: Sequence[str], field: str = "field", value: str = "value") -> DataFrame:
    """(keys, field, verdict) of two long tables of fields: same, format (equal but for case and blanks), missing in a / b, different."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    left, right = a.select(*keys, field, F.col(value).alias("_a")), b.select(*keys, field, F.col(value).alias("_b"))
    va, vb = F.nullif(F.col("_a"), F.lit("")), F.nullif(F.col("_b"), F.lit(""))
    verdict = F.when(va.isNull() & vb.isNull(), "same").when(va.isNull(), "missing in a").when(vb.isNull(), "missing in b").when(va == vb, "same").when(plain(va) == plain(vb), "format").otherwise("different")
    return left.join(right, [*keys, field], "full").select(*keys, field, verdict.alias("verdict"))


def header_verdict(kind: Column, a: Column, b: Column) -> Column:
    """The verdict of two values of a header field; ``kind`` is date, payment or another.

    missing in a / b; ok if equal but for case and outer blanks, or for payment terms of one meaning; dates
    that both can be read: format, doubtful (equal with day and month exchanged) or different; two numbers:
    format within half a hundredth, else different; other texts by the ratio of their sorted words: format
    from 92, doubtful from 70, else different. Both null is null.
    """
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    day_a, day_b, number_a, number_b = parse_date(a), parse_date(b), parse_number(a), parse_number(b)
    ratio = token_sort_ratio(x, y)
    days = F.when(day_a == day_b, "format").when(dates_possibly_equal(a, b), "doubtful").otherwise("different")
    values = F.when(F.abs(number_a - number_b) * 1000 < 5, "format").otherwise("different")
    words = F.when(ratio >= 92, "format").when(ratio >= 70, "doubtful").otherwise("different")
    present = F.when(a.isNull() & b.isNull(), None).when(a.isNull(), "missing in a").when(b.isNull(), "missing in b").when(x == y, "ok")
    by_kind = present.when((kind == "date") & day_a.isNotNull() & day_b.isNotNull(), days).when((kind == "payment") & (F.lower(payment_terms(a)) == F.lower(payment_terms(b))), "ok")
    return by_kind.when(number_a.isNotNull() & number_b.isNotNull(), values).otherwise(words)


def changed_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, column, old, new) of every column whose value changed, null-safe; rows on one side only count against nulls."""
    columns = [c for c in new.columns if c != key]
    left, right = old.select(key, F.struct(*columns).alias("o")), new.select(key, F.struct(*columns).alias("n"))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")) for c in columns))
    every = left.join(right, key, "full").select(key, F.explode(cells).alias("c")).select(key, "c.*")
    return every.filter(~F.col("old").eqNullSafe(F.col("new")))


def keep_known(new: Column, old: Column) -> Column:
    """A new value that is not blank, else the old one."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)
