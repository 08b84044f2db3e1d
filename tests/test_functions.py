"""Cases of the column functions that the tables do not hold."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import codes, dates, numbers, similarity, text
from tallybook.operators import linkage, timing


def values(spark, pairs, f):
    frame = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(pairs)], "k int, s string")
    return [r[0] for r in frame.orderBy("k").select(f(F.col("s"))).collect()]


NUMBERS = [
    ("13.500,00", "13500"), ("13,500.00", "13500"), ("13 500,00", "13500"), ("13500.00", "13500"), ("1.234.567,89", "1234567.89"), ("1,234,567", "1234567"),
    ("1.234", "1234"), ("0,500", "0.5"), ("0.257", "0.257"), ("+1.234", "1.234"), ("-1.234", "-1234"), ("5%", None), ("12 USD", None), ("", None), (None, None),
    ("n/a", None), ("-", None), ("1.5e3", "1500"), ("1.234,56-2.345,67", None), ("1.2.3.4.5", None), ("€ 5,5", "5.5"), ("NaN", None), ("Infinity", None), ("1_000", None), ("9" * 51, None), ("–7,25", "-7.25"),
]


def test_numbers(spark):
    assert values(spark, NUMBERS, numbers.parse_number) == [None if v is None else Decimal(v) for _, v in NUMBERS]


DATES = [
    ("2024-1-5", dt.date(2024, 1, 5)), ("2024.01.15", dt.date(2024, 1, 15)), ("30/06/2025", dt.date(2025, 6, 30)), ("06/30/2025", dt.date(2025, 6, 30)), ("5 January 2024", dt.date(2024, 1, 5)),
    ("12 sty 2023", dt.date(2023, 1, 12)), ("1989-01-01", None), ("31.02.2024", None), ("", None), (None, None),
]


def test_dates(spark):
    assert values(spark, DATES, dates.parse_date) == [v for _, v in DATES]


def test_references(spark):
    pairs = [("NL753-S-40", "NL753S40"), ("nl753 s/40", "NL753S40"), ("S040", "S040"), ("A.1", "A.1"), (None, "")]
    assert values(spark, pairs, text.loose_ref) == [v for _, v in pairs]
    frame = spark.createDataFrame([("NL753-S-40", "NL753S40"), ("S040", "S40"), ("NL753S40", "NL753S45"), ("AB", "AC"), ("", "A")], "a string, b string")
    assert [r[0] for r in frame.select(similarity.ref_verdict(F.col("a"), F.col("b"))).collect()] == ["same", "zeros", "size", "open", "missing"]


def test_barcodes(spark):
    pairs = [("5901234123457", True), ("5901234123458", False), ("96385074", True), ("036000291452", True), ("x", False), ("", False)]
    assert values(spark, pairs, codes.gtin_valid) == [v for _, v in pairs]


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "abc"), ("kitten", "sitting"), ("a", "b"), ("AB12", "AB21")])
def test_common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common_length(a, b) == table[-1][-1]


def test_greedy_pairs(spark):
    frame = spark.createDataFrame([(1, "a", "x", 90.0), (1, "b", "x", 95.0), (1, "a", "y", 80.0), (2, "a", "x", 90.0)], "g int, a string, b string, s double")
    got = sorted(tuple(r)[:3] for r in linkage.greedy_pairs(frame, "g", "a", "b", "s").collect())
    assert got == [(1, "a", "y"), (1, "b", "x"), (2, "a", "x")]


def test_free_time_edges(spark):
    frame = spark.createDataFrame([("2024-01-01", None), ("2024-01-01", "2023-12-01"), (None, None), ("2024-01-01", "2024-01-15")], "a string, b string")
    t = timing.free_time(F.col("a").cast("date"), F.col("b").cast("date"), 14, 3, 10.0, F.lit("2024-01-15").cast("date"))
    got = [r["t"] for r in frame.select(t.alias("t")).collect()]
    assert (got[0]["level"], got[0]["cost"]) == ("red", Decimal("0.00"))
    assert (got[1]["used"], got[1]["level"]) == (0, "green")
    assert got[2] is None
    assert got[3]["level"] == "green"


def test_prefix_candidates_against_brute_force(spark):
    master = ["M0123", "M012", "M01-2", "AB12C", "M", "77", "7", "M0124X5"]
    items = ["M01", "M012", "M", "AB12C", "AB1", "7", "", "M0124X"]
    got = linkage.prefix_candidates(spark.createDataFrame([(i,) for i in items], "i string"), "i", spark.createDataFrame([(m,) for m in master], "m string"), "m")
    want = {(i, m) for i in items for m in master if m.startswith(i) and not m[len(i) :].strip("0123456789")}
    assert {(r["i"], r["m"]) for r in got.collect()} == want
