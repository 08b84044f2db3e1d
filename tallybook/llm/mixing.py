"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only.

A source of weight w gets block i between its release, slot floor(i / w), and its deadline, slot
ceil((i + 1) / w). Taking in each slot the released block with the earliest deadline keeps every source
within less than one block of w times the slots so far. Weights are whole numbers over their sum, so all of
this is exact: a source's lag is its weight times the slots less the sum times its blocks, never over one
sum. The schedule is worked out once from slot to slot, on one row that holds each source's lag at the
start of every stretch of slots; the stretches' picks are then listed in parallel. It repeats after as many
slots as the weights' sum. A source that ends leaves its slots empty; the others go on in their proportions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole

#: Documents in a block.
BLOCK = 64
#: Without given weights a source weighs as its number of documents to this power, in parts of 1 / UNIT.
TEMPERATURE = 0.5
UNIT = 1024
#: Slots whose picks one row lists.
STRETCH = 4096
#: Sources at most: the lags of all of them stand in one row.
MOST_SOURCES = 10_000
#: The weights' sum at most.
_LARGEST = 1 << 60
_FOREVER = 1 << 40


def _source_key(source: str) -> Column:
    """A key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def whole_weights(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """The weights as whole numbers in the same proportions, and their mean.

    Decimal fractions are held exactly; only where the whole numbers would need more than 60 bits are they
    rounded to that precision. Weights that are not over zero are refused.
    """
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be over zero")
    mean = sum(exact.values(), Fraction(0)) / max(1, len(exact)) or Fraction(1)
    every = [*exact.values(), mean]
    unit = Fraction(math.lcm(*(w.denominator for w in every)), math.gcd(*(w.numerator * (math.lcm(*(v.denominator for v in every)) // w.denominator) for w in every)))
    if sum(every) * unit * MOST_SOURCES > _LARGEST:
        unit = Fraction(_LARGEST // MOST_SOURCES) / sum(every)
    return {k: max(1, round(w * unit)) for k, w in exact.items()}, max(1, round(mean * unit))


def weighed(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, n, weight): each source's weight as a whole number. ``counts``: (key, n). Sources not in ``weights`` have their mean weight."""
    if weights is None:
        weight = F.greatest(F.lit(1), F.round(F.col("n").cast("double") ** TEMPERATURE * UNIT))
    else:
        whole, mean = whole_weights(weights)
        weight = F.lit(mean)
        if whole:
            weight = F.coalesce(F.try_element_at(F.create_map(*(x for k, w in whole.items() for x in (F.lit(f"={k}"), F.lit(w).cast("long")))), F.col("key")), weight)
    return counts.select("key", "n", weight.cast("long").alias("weight"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, n, turn, slot, share, span): the slot of each source's turns, by earliest deadline first, from slot 0 to before ``span``.

    ``sources``: (key, n, weight). ``span`` is the weights' sum, after which the schedule repeats and each
    source has had ``share`` turns, or the slots until the last block's deadline if these are fewer.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("key", "n", "weight"))).alias("s"), F.sum("weight").alias("total"))
    small = F.when(F.size("s") <= MOST_SOURCES, F.col("s")).otherwise(F.raise_error(F.lit(f"over {MOST_SOURCES} sources")))
    one = one.filter(F.size("s") > 0).select(small.alias("s"), "total")
    last = F.array_max(F.transform("s", lambda x: F.ceil(F.ceil(x["n"] / block) * F.col("total") / x["weight"]) + 1))
    one = one.withColumn("w", F.transform("s", lambda x: x["weight"])).withColumn("span", F.least("total", last.cast("long")))
    ids, total = F.sequence(F.lit(0), F.size("s") - 1), F.col("total")

    def advance(state: Column, listed: bool) -> Column:
        """The state one slot later; with ``listed`` the pick and its turn are noted."""

        def bid(lags: Column, k: Column) -> Column:
            lag, weight = F.get(lags, k), F.get(F.col("w"), k)
            return F.when(lag > 0, F.struct(F.call_function("div", total - lag + weight - 1, weight).alias("wait"), k.alias("k")))

        def take(lags: Column, pick: Column) -> Column:
            less = F.transform(lags, lambda x, k: x - F.when(k == pick, total).otherwise(0))
            done = F.transform(state["done"], lambda x, k: x + F.when(k == pick, 1).otherwise(0).cast("long"))
            noted = [F.array_append(state["order"], F.struct(pick.alias("k"), F.get(state["done"], pick).alias("turn"))).alias("order")] if listed else []
            return F.struct(less.alias("lag"), done.alias("done"), *noted)

        return _let(F.zip_with(state["lag"], F.col("w"), lambda x, w: x + w), lambda lags: _let(F.array_min(F.transform(ids, lambda k: bid(lags, k)))["k"], lambda pick: take(lags, pick)))

    zeros = F.transform(ids, lambda _: F.lit(0).cast("long"))
    state = F.struct(zeros.alias("lag"), zeros.alias("done"))
    slots = F.sequence(F.lit(1), F.lit(STRETCH))
    stretches = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("span") - 1, F.lit(STRETCH).cast("long")))
    starts = F.aggregate(
        F.slice(stretches, F.lit(2), F.size(stretches)),
        F.array(state),
        lambda found, _: F.array_append(found, F.aggregate(slots, F.element_at(found, -1), lambda at, _: advance(at, False))),
    )
    rows = one.select("s", "w", "total", "span", F.posexplode(starts).alias("stretch", "start"))
    # By number, so that the few small rows are not put together again into one task.
    rows = rows.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stretch")
    begin = F.struct(F.col("start.lag").alias("lag"), F.col("start.done").alias("done"), F.array().cast("array<struct<k:int,turn:bigint>>").alias("order"))
    order = F.aggregate(slots, begin, lambda at, _: advance(at, True))["order"]
    picked = rows.select("s", "total", "span", "stretch", F.posexplode(order).alias("place", "o"))
    picked = picked.select(F.get("s", F.col("o.k")).alias("x"), F.col("o.turn").alias("turn"), (F.col("stretch").cast("long") * STRETCH + F.col("place")).alias("slot"), "span", "total").filter("slot < span")
    share = F.when(F.col("span") == F.col("total"), F.col("x.weight")).otherwise(F.lit(_FOREVER))
    return picked.select("x.key", "x.n", "turn", "slot", share.alias("share"), "span")


def mixed(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    block: int = BLOCK,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """(doc_id, source, block, slot, position): every document's place in the mixture.

    Within a source documents stand in an order shuffled by the MD5 of their id and are cut into blocks of
    ``block`` (the last may be shorter). ``slot`` is the block's place in the endless schedule;
    ``position`` counts documents from 0 without gaps. In any stretch from the start in which no source has
    ended, each source has within less than one block of its weight's share of the slots.

    Nothing is dropped or repeated: equal ids keep a row each (ties by source order are arbitrary but
    counted once each), null ids come first in their source's order, a null source is a source of its own.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), _source_key(source_column).alias("key"), F.coalesce(F.md5(F.col(id_column).cast("string")), F.lit("")).alias("draw"))
    # Buckets of the shuffled order hold about 20,000 documents at most, a source's rows spread over all of them.
    buckets = 1 << max(8, math.ceil(math.log2(documents.count() / 20_000 + 1)))
    rows = rows.withColumn("bucket", F.coalesce(F.expr(f"cast(conv(substring(draw, 1, 8), 16, 10) as long) div {(1 << 32) // buckets}"), F.lit(0)))
    sizes = rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("key", "bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("draw", "doc_id"))
    numbered = rows.withColumn("own", own).join(offsets, ["key", "bucket"]).select("key", "doc_id", "source", (F.col("before") + F.col("own") - 1).alias("number"))

    turns = schedule(weighed(sizes.groupBy("key").agg(F.sum("n").alias("n")), weights), block)
    # A turn's blocks: one of each repetition of the schedule.
    blocks = turns.filter(f"turn * {block} < n").select("key", "n", "turn", "slot", "share", "span", F.explode(F.sequence("turn", F.expr(f"(n - 1) div {block}"), "share")).alias("block"))
    at = F.col("slot") + F.col("span") * F.expr("(block - turn) div share")
    placed = stored(blocks.select("key", "block", at.alias("slot"), F.least(F.lit(block), F.col("n") - F.col("block") * block).alias("size")), "mix-blocks")
    stretch = F.expr(f"slot div {STRETCH}")
    totals = placed.groupBy(stretch.alias("stretch")).agg(F.sum("size").alias("n"))
    # One row for each stretch of slots.
    base = totals.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("stretch").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = placed.withColumn("stretch", stretch).withColumn("within", within).join(base, "stretch").select("key", "block", "slot", (F.col("base") + F.col("within")).alias("begin"))
    docs = numbered.withColumn("block", F.expr(f"number div {block}"))
    return docs.join(begins, ["key", "block"]).select("doc_id", "source", "block", "slot", (F.col("begin") + F.col("number") % block).alias("position"))


def in_mixed_order(documents: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents with all their columns, stored in the order of the mixture: files and rows in them ascend by position."""
    rows = documents.select(whole(documents), "doc_id", "source")
    places = mixed(documents, weights, block).select(F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), "position")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("source").eqNullSafe(F.col("own_source"))
    if rows.groupBy("doc_id", "source").count().filter("count > 1").limit(1).count():
        # Rows with equal ids and sources take their places one each.
        places = places.withColumn("own_copy", F.row_number().over(Window.partitionBy("own_id", "own_source").orderBy("position")))
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy(F.xxhash64("document"))))
        same = same & (F.col("copy") == F.col("own_copy"))
    joined = rows.join(places, same).select("document", "position")
    # Positions have no gaps, so equal stretches of them are equal parts.
    parts, every = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, documents.count())
    part = F.expr(f"cast(position * {parts} div {every} as int)")
    return joined.repartitionById(parts, part).sortWithinPartitions("position").select("document.*")
