"""Sums over shared terms in blocks, and the queries that rest on them."""

import random

import pytest
from pyspark.sql import functions as F

from tallybook.operators import descriptions, products
from tallybook.plans import registry
from tests.test_structures import WORDS, plain_blend, plain_cosines

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block,part", [(1 << 22, 1 << 20), (40, 30)])
def test_shared_sums_by_brute_force(spark, monkeypatch, block, part):
    """In one block and in many: counts, weighted sums and the first of each."""
    monkeypatch.setattr(products, "BLOCK", block)
    monkeypatch.setattr(products, "PART", part)
    draw = random.Random(4)
    rows = lambda n: [(k, (terms := draw.sample(range(12), draw.randrange(0, 7))), [draw.randrange(1, 5) / 2 for _ in terms]) for k in range(n)]
    a, b = rows(30), rows(50)
    ta, tb = spark.createDataFrame(a, "i long, terms array<long>, weights array<double>"), spark.createDataFrame(b, "j long, terms array<long>, weights array<double>")
    total = lambda x, y, plain: sum(1 if plain else w * v for t, w in zip(*x[1:]) for u, v in zip(*y[1:]) if t == u)
    for plain in (True, False):
        sides = [t.drop("weights") if plain else t for t in (ta, tb)]
        want = {(x[0], y[0]): s for x in a for y in b if (s := total(x, y, plain)) >= 2}
        assert {(r.i, r.j): r.total for r in products.shared_sums(*sides, 2).collect()} == want
        got = {(r.i, r.j): r.total for r in products.shared_sums(*sides, 2, first=3).collect()}
        best = {k: v for k, v in want.items() if sum((-v2, k2) < (-v, k) for k2, v2 in want.items() if k2[0] == k[0]) < 3}
        assert got.items() <= want.items() and best.items() <= got.items()
    keyed = products.shared_sums(ta.drop("weights").withColumn("i", F.struct("i", F.lit("x").alias("of"))), tb.drop("weights"), 2)
    assert keyed.select("i.i", "i.of", "j").distinct().count() == sum(total(x, y, True) >= 2 for x in a for y in b)
    assert products.shared_sums(ta.limit(0), tb, 2).count() == 0 and products.shared_sums(ta, tb.limit(0), 2).count() == 0


@pytest.mark.parametrize("name", ["m09_word_similarity", "m09_description_cosines", "m09_blended_matches", "j22_suggest_by_text"])
def test_pairs_do_not_meet_on_terms(spark, monkeypatch, name):
    """No join on a word or gram makes pairs."""
    met = []
    monkeypatch.setattr(products, "shared_sums", seen := lambda *args, f=products.shared_sums, **kwargs: met.append(1) or f(*args, **kwargs))
    monkeypatch.setattr(descriptions, "shared_sums", seen)
    monkeypatch.setattr(descriptions, "FEW_PAIRS", 0)
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert met and not [line for line in plan.splitlines() if "Join" in line and ("[w#" in line or "gram" in line)]


def test_large_groups_as_small_ones(spark, monkeypatch):
    """A group's texts, which often repeat, compared in blocks."""
    draw = random.Random(8)
    text = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 5)))
    corpus, asked = [text() for _ in range(50)] + ["gauze swab"] * 4, [text() for _ in range(25)] + ["gauze swabs"] * 3
    frame = lambda texts, key: spark.createDataFrame([(g, k, t) for g in (1, 2) for k, t in enumerate(texts[g - 1 :])] + [(3, 0, "tube")] * (key == "i"), f"doc int, {key} int, text string")
    monkeypatch.setattr(descriptions, "FEW_PAIRS", 0)
    monkeypatch.setattr(products, "PART", 100)
    for g in (1, 2):
        want = plain_cosines(corpus[g - 1 :], asked[g - 1 :])
        got = {(r.i, r.j): r.cosine for r in descriptions.cosine_pairs(frame(asked, "i"), frame(corpus, "j"), ["doc"], "i", "j", "text", 0.4).filter(F.col("doc") == g).collect()}
        assert set(got) == {(i, j) for i, row in enumerate(want) for j, c in enumerate(row) if c >= 0.4} and all(abs(c - want[i][j]) < 1e-9 for (i, j), c in got.items())
        near = {(r.i, r.j): r.similarity for r in descriptions.similar_pairs(frame(asked, "i"), frame(corpus, "j"), ["doc"], "i", "j", "text").filter(F.col("doc") == g).collect()}
        blends = {(i, j): plain_blend(t, u, want[i][j]) for i, t in enumerate(asked[g - 1 :]) for j, u in enumerate(corpus[g - 1 :])}
        assert set(near) == {k for k, v in blends.items() if v >= 0.55} and all(abs(v - blends[k]) < 1e-9 for k, v in near.items())


def test_equal_descriptions_are_weighed_once(spark, tmp_path):
    """Eight copies of 60 parts: as many rows of weights as there are different texts."""
    parts = spark.read.parquet(f"{DATA}/part.parquet").limit(60)
    parts.crossJoin(spark.range(8)).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("id")).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.queries()["w23_description_weights"](spark, str(tmp_path))
    assert rows.count() == 480
    texts = descriptions.distinct_texts(rows.select(F.lit(0).alias("g"), F.col("n_grams").cast("string").alias("text")), ["g"], "text")
    assert texts.agg(F.sum("n")).first()[0] == 480 and texts.count() < 60
