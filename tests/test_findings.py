"""Findings, fuzzy pairs and roles against plain accounts."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallybook.functions import headers, similarity
from tallybook.operators import compare, descriptions, groups, linkage
from tallybook.plans import registry
from tests.compare import rows as compared
from tests.test_queries import indel


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("AB01I") for _ in range(rng.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("least", [30.0, 55.0, 85.0, 100.0])
def test_fuzzy_candidates_miss_nothing(spark, least):
    a, b = [(k % 3, w) for k, w in enumerate(words(90, 1))] + [(None, "A"), (1, None)], [(k % 3, w) for k, w in enumerate(words(90, 2))] + [(None, "A")]
    side = lambda rows: spark.createDataFrame(rows, "g int, w string")
    got = {(r["g"], r["a"], r["b"]): r["score"] for r in linkage.fuzzy_candidates(side(a), side(b), "g", "w", least).collect()}
    want = {(g, x, y): indel(x, y) for (g, x), (h, y) in itertools.product(a, b) if None not in (g, h, x, y) and g == h and indel(x, y) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_greedy_pairs_by_rounds_as_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), rng.randint(0, 15), rng.randint(0, 15), float(rng.randint(0, 3))) for _ in range(300)] + [(0, 1, 1, None), (None, 1, 1, 2.0), (1, 2, 2, 9.0), (1, 2, 2, 9.0)]
    frame = spark.createDataFrame(rows, "g int, a int, b int, s double")
    by_rounds = {tuple(r) for r in linkage.greedy_pairs(frame, "g", "a", "b", "s", few=0).collect()}
    assert by_rounds == {tuple(r) for r in linkage.greedy_pairs(frame, "g", "a", "b", "s").collect()}
    ties = {tuple(r)[:3]: r["tie"] for r in frame.select("g", "a", "b", F.xxhash64("g", "a", "b").alias("tie")).collect()}
    want, used = set(), set()
    for g, a, b, s in sorted({r for r in rows if None not in r}, key=lambda r: (-r[3], ties[r[:3]], r)):
        if not {(g, "a", a), (g, "b", b)} & used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b, s))
    assert by_rounds == want


def test_missing_refs(spark):
    a = spark.createDataFrame([(1, "AB100I"), (1, "AB2005"), (1, "AB30001X"), (1, "ZZ"), (1, "SAME"), (1, None), (2, "AB100I"), (1, "ZZ")], "doc int, ref string")
    b = spark.createDataFrame([(1, "AB1001"), (1, "AB200S"), (1, "AB30001"), (1, "SAME"), (2, None)], "doc int, ref string")
    got = {(r["doc"], r["ref"]): (r["verdict"], r["partner"]) for r in linkage.missing_refs(a, b, "doc", "ref", 80.0).collect()}
    assert got == {(1, "AB100I"): ("swap", "AB1001"), (1, "AB2005"): ("characters", "AB200S"), (1, "AB30001X"): ("typo", "AB30001"), (1, "ZZ"): ("missing", None), (2, "AB100I"): ("missing", None)}


def test_field_category(spark):
    cases = [(None, "", None), ("a", None, "missing"), ("", "b", "missing"), (" ab ", "AB", None), ("LOT1I", "LOTI1", "swap"), ("AB20S5", "AB2055", "characters"), ("order of ten boxes", "order of ten boxs", "format"), ("ordering", "ordring", "typo"), ("orders", "bills", "different")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: r["c"] for r in frame.select("k", similarity.field_category(F.col("a"), F.col("b")).alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == [c for _, _, c in cases]


def test_changed_lines(spark):
    cases = [(None, None, (0, 0)), ("", "\n \n", (0, 0)), ("a\nb", "a\n\n b ", (0, 2)), ("one line here\nb\nc", "one line here!\nx", (2, 3)), (None, "a", (1, 1))]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: tuple(r["c"]) for r in frame.select("k", similarity.changed_lines("a", "b").alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == [c for _, _, c in cases]


def test_header_verdict(spark):
    cases = [
        ("date", "2024-03-05", "05.03.2024", "format"), ("date", "2024-03-05", "2024-03-06", "different"), ("date", "2024-03-05", None, "missing in b"), ("date", None, None, None),
        ("payment", "IW04", "within 30 days", "ok"), ("payment", "net 60 days", "in advance", "different"), ("amount", "1,234.56", "1.234,56", "format"), ("amount", "1,234.56", "1,235.56", "different"),
        ("name", " Acme Ltd", "ACME LTD", "ok"), ("name", "Ltd Acme", "acme ltd", "format"), ("name", "Acme Trading Ltd", "Acme Tradin", "doubtful"), ("name", "Acme", "Zeta", "different"),
    ]
    frame = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, kind string, a string, b string")
    got = {r["k"]: r["v"] for r in frame.select("k", compare.header_verdict(F.col("kind"), F.col("a"), F.col("b")).alias("v")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[3] for c in cases]


def test_column_roles(spark):
    rng = random.Random(5)
    pool = ["No.", "item", "Qty", "unit price", "net weight", "net", "35", "VAT", "remarks", "", None, "order unit", "Kod CN", "gross weight", "total value"]
    rows = [[rng.choice(pool) for _ in range(rng.randint(0, 7))] for _ in range(60)]
    got = {r["k"]: r["roles"] for r in spark.createDataFrame(list(enumerate(rows)), "k int, h array<string>").select("k", headers.column_roles(F.col("h")).alias("roles")).collect()}
    for k, row in enumerate(rows):
        want = ["skip"] * len(row)
        for role, keys in headers.ROLE_WORDS.items():
            for i, h in enumerate((h or "").strip().lower() for h in row):
                if want[i] == "skip" and any(w == h or (len(w) > 3 and w in h) for w in keys):
                    want[i] = role
                    break
        assert got[k] == want, row


def test_compare_items_pair_repeated_references_by_turn(spark):
    row = "doc int, ref string, qty decimal(18,2), net decimal(18,2), unit string, line int"
    from decimal import Decimal as D

    item = lambda ref, qty, line: (1, ref, D(qty), D(10 * qty), "PCS", line)
    a = spark.createDataFrame([item("X", 1, 1), item("X", 2, 2), item("X", 3, 3), item(None, 1, 4)], row)
    b = spark.createDataFrame([item("X", 1, 1), item("X", 5, 2), item(None, 1, 4)], row)
    got = sorted((r["ref"] or "", r["status"]) for r in compare.compare_items(a, b).collect())
    assert got == [("", "missing in a"), ("", "missing in b"), ("X", "different"), ("X", "missing in b"), ("X", "ok")]


@pytest.mark.parametrize("name", ["a12_risk", "a13_status_counts", "a14_third_roll_up", "a16_distinct_findings", "c01_compare_items", "c07_findings", "c11_findings_of_audit", "c23_price_tolerance", "f17_alert"])
def test_compared_parts_of_one_cut_reference(spark, tmp_path, name):
    """From a million parts on, references are cut to six digits, and parts of one document share one."""
    keys = [(doc, 1_000_000 + 10 * ref + last) for doc in range(1, 60) for ref in (doc % 3, 5) for last in range(1 + (doc + ref) % 4)]
    rows = [(doc, part, 1, k % 7 + 1, float(part % 9 + 1), float(part % 13 + 2) * 10) for k, (doc, part) in enumerate(keys)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert compared(got[want.columns]) == compared(want)


@pytest.mark.parametrize("least,long", [(40.0, ""), (70.0, ""), (93.0, ""), (55.0, "x" * 45), (100.0, "")])
def test_best_pairs_from_the_top_as_of_all_candidates(spark, monkeypatch, least, long):
    """The same pairs, and of 80 alike names none is left to be compared at the least ratio."""
    names = lambda n, seed: [(k % 3, w + (long if k % 5 == 0 else "")) for k, w in enumerate(words(n, seed))] + [(None, "A"), (1, None), (4, "A" * seed)]
    side = lambda rows: spark.createDataFrame(rows, "g int, w string")
    a, b = side(names(60, 1)), side(names(90, 2))
    want = {tuple(r) for r in linkage.greedy_pairs(linkage.fuzzy_candidates(a, b, "g", "w", least), "g", "a", "b", "score").collect()}
    assert {tuple(r) for r in linkage.best_fuzzy_pairs(a, b, "g", "w", least).collect()} == want
    two = {(r["g"], r["a"], r["b"]): r["score"] for r in linkage.two_apart(a, b, "g", "w").collect()}
    plain = {(g, x, y): indel(x, y) for (g, x), (h, y) in itertools.product(names(60, 1), names(90, 2)) if None not in (g, h, x, y) and g == h and round((len(x) + len(y)) * (1 - indel(x, y) / 100)) <= 2}
    assert two.keys() == plain.keys() and all(abs(two[k] - plain[k]) < 1e-9 for k in plain)
    met = []
    monkeypatch.setattr(linkage, "fuzzy_candidates", lambda *args, f=linkage.fuzzy_candidates: met.append(args[-1]) or f(*args))
    even = spark.createDataFrame([(1, f"name-{k:04}") for k in range(0, 80, 2)], "g int, w string")
    linkage.best_fuzzy_pairs(even, spark.createDataFrame([(1, f"name-{k:04}") for k in range(1, 80, 2)], "g int, w string"), "g", "w", 30.0)
    assert 30.0 not in met


@pytest.mark.parametrize("few", [0, 4096])
def test_fuzzy_candidates_of_large_and_small_groups(spark, monkeypatch, few):
    """Groups of few pairs are compared within a task, larger ones by shared characters; the pairs are the same."""
    monkeypatch.setattr(groups, "FEW_PAIRS", few)
    a, b = [(k % 3, w) for k, w in enumerate(words(60, 5))] + [(None, "A"), (7, "B")], [(k % 3, w) for k, w in enumerate(words(60, 6))] + [(8, "B")]
    side = lambda rows: spark.createDataFrame(rows, "g int, w string")
    for least in (40.0, 80.0):
        got = {(r["g"], r["a"], r["b"]): r["score"] for r in linkage.fuzzy_candidates(side(a), side(b), "g", "w", least).collect()}
        want = {(g, x, y): indel(x, y) for (g, x), (h, y) in itertools.product(a, b) if g is not None and g == h and indel(x, y) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_stretch_by_counted_characters():
    """Only stretches that can be better are looked at, and the best is the same; a blend under the least one stays under it."""
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9)))
    for _ in range(500):
        a, b, over = text(), text(), rng.choice([0.0, 40.0, 75.0])
        short, long = sorted((a, b), key=len)
        pairs = [(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))]
        pairs += [(long, short[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(short))] if len(a) == len(b) else []
        assert abs(descriptions.part_ratio(a, b, over) - max(over, *(indel(x, y) for x, y in pairs))) < 1e-9
        cosine, least = rng.random(), rng.choice([0.5, 0.7])
        whole, told = descriptions.blend(a, b, cosine), descriptions.blend(a, b, cosine, least)
        assert told < least if whole < least else abs(told - whole) < 1e-12
