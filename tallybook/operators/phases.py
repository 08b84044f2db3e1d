"""One-to-one linkage of two documents' items in four phases, each of which hands on what it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ref_verdict
from ..functions.text import loose_ref, product_text
from .descriptions import MATCH, similar_pairs
from .linkage import fuzzy_candidates, greedy_pairs, ordered_pairs
from .storage import stored

#: The least ratio of two references.
ALIKE = 85.0


def linked_items(a: DataFrame, b: DataFrame, least_ref: float = ALIKE, least_description: float = MATCH) -> DataFrame:
    """(doc, i, j, phase, confidence) of the items (doc, place, ref, description) of ``a`` and ``b``: i and j are their places.

    exact: items of one normalised reference pair by turn, in the order of places. fuzzy: of the rest, references
    alike by ``least_ref`` that are neither apart in zeros nor in their last number alone, best pairs first, then by
    places. description: of the rest, each item of ``a`` in its order takes the free item of ``b`` whose description is
    most like its own, from ``least_description`` on; grams are weighed by the descriptions that are left in ``b``.
    only_a, only_b: the rest. Places are those of one item in its document; null or blank references and descriptions match nothing.
    """
    side = lambda t: t.select("doc", "place", loose_ref(F.col("ref")).alias("ref"), product_text(F.col("description")).alias("text"))
    a, b = stored(side(a), "items-a"), stored(side(b), "items-b")
    turn = F.row_number().over(Window.partitionBy("doc", "ref").orderBy("place"))
    exact = lambda t, name: t.filter("ref <> ''").select("doc", "ref", turn.alias("turn"), F.col("place").alias(name))
    pairs = exact(a, "i").join(exact(b, "j"), ["doc", "ref", "turn"]).select("doc", "i", "j", F.lit("exact").alias("phase"), F.lit(1.0).alias("confidence"))
    found = stored(pairs, "exact")

    def left(t: DataFrame, name: str) -> DataFrame:
        return t.join(found.select("doc", F.col(name).alias("place")), ["doc", "place"], "left_anti")

    rest_a, rest_b = left(a, "i").filter("ref <> ''"), left(b, "j").filter("ref <> ''")
    alike = fuzzy_candidates(rest_a, rest_b, "doc", "ref", least_ref).filter(ref_verdict(F.col("a"), F.col("b")) == "open")
    alike = alike.join(rest_a.select("doc", F.col("ref").alias("a"), F.col("place").alias("i")), ["doc", "a"]).join(rest_b.select("doc", F.col("ref").alias("b"), F.col("place").alias("j")), ["doc", "b"])
    best = greedy_pairs(alike.select("doc", "i", "j", (F.col("score") / 100).alias("confidence")), "doc", "i", "j", "confidence", by_keys=True)
    found = stored(found.union(best.select("doc", "i", "j", F.lit("fuzzy"), "confidence")), "fuzzy")

    rest_a, rest_b = left(a, "i").filter("text <> ''"), left(b, "j").filter("text <> ''")
    near = similar_pairs(rest_a.withColumnRenamed("place", "i"), rest_b.withColumnRenamed("place", "j"), ["doc"], "i", "j", "text", least_description)
    meant = ordered_pairs(near, "doc", "i", "j", "similarity")
    found = stored(found.union(meant.select("doc", "i", "j", F.lit("description"), "similarity")), "meant")

    none = F.lit(None).cast(a.schema["place"].dataType)
    only_a = left(a, "i").select("doc", F.col("place").alias("i"), none.alias("j"), F.lit("only_a").alias("phase"), F.lit(0.0).alias("confidence"))
    only_b = left(b, "j").select("doc", none.alias("i"), F.col("place").alias("j"), F.lit("only_b").alias("phase"), F.lit(0.0).alias("confidence"))
    return found.union(only_a).union(only_b)
