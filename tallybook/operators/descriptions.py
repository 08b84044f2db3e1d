"""Alike descriptions: cosines of weighted character grams, met in blocks, and the blend with text ratios."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import common_length, indel_ratio, sorted_words
from . import groups
from .groups import FEW_PAIRS
from .products import shared_sums
from .storage import stored

#: Shares of the cosine and of the texts' ratio in the blend, and the blend from which two descriptions match.
COSINE_SHARE = 0.6
RATIO_SHARE = 0.4
MATCH = 0.55


@lru_cache(100_000)
def grams_of_word(word: str, shortest: int = 2, longest: int = 4) -> tuple[str, ...]:
    """All runs of 2 to 4 characters of a word and a blank at each of its ends; the whole once where that is shorter."""
    w = f" {word} "
    sizes = range(shortest, min(longest, len(w)) + 1)
    return tuple(w[k : k + n] for n in sizes for k in range(len(w) - n + 1))


def grams(texts: Column) -> Column:
    """A text's grams with their numbers of occurrences; null and blank texts have none."""

    @F.pandas_udf("array<struct<gram:string,tf:int>>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: list(Counter(g for w in (t or "").split() for g in grams_of_word(w)).items()))

    return run(texts)


def distinct_texts(rows: DataFrame, group: Sequence[str], text: str) -> DataFrame:
    """(group, text, n, id): the different texts of each group with their numbers of rows. All work on texts is done once for each."""
    return stored(rows.groupBy(*group, text).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "texts")


def fitted(texts: DataFrame, group: Sequence[str], text: str) -> DataFrame:
    """(group, gram, df, idf, term) over the rows of ``distinct_texts``: the logarithm of (1 + rows) over (1 + rows with the gram), and 1; term numbers them."""
    n = texts.groupBy(*group).agg(F.sum("n").alias("rows"))
    df = texts.select(*group, "n", F.explode(grams(F.col(text))).alias("_gram")).groupBy(*group, F.col("_gram.gram").alias("gram")).agg(F.sum("n").alias("df"))
    found = df.join(n, list(group)).select(*group, "gram", "df", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
    return stored(found.withColumn("term", F.monotonically_increasing_id()), "idf")


def vectors(texts: DataFrame, idf: DataFrame, group: Sequence[str], text: str) -> DataFrame:
    """(id, terms, weights): unit vectors of the texts, of the fitted grams only. A gram of tf occurrences weighs (1 + ln tf) x idf."""
    found = texts.select(*group, "id", F.explode(grams(F.col(text))).alias("_gram")).select(*group, "id", "_gram.gram", "_gram.tf").join(idf, [*group, "gram"])
    v = found.groupBy("id").agg(F.collect_list(F.struct("term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda sum, x: sum + x["w"] * x["w"]))
    return v.withColumn("length", length).select("id", F.col("v.term").alias("terms"), F.transform("v.w", lambda w: w / F.col("length")).alias("weights"))


def _of_group(a: list[str], b: list[str], least: float) -> list[tuple[int, int, float]]:
    """The places of all pairs of two lists of texts and their cosines, from ``least`` on; the weights are fitted on ``b``."""
    counted = [[Counter(g for w in t.split() for g in grams_of_word(w)) for t in side] for side in (a, b)]
    df = Counter(g for c in counted[1] for g in c)
    idf = {g: math.log((1 + len(b)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c: Counter) -> dict[str, float]:
        v = {g: (1 + math.log(tf)) * idf[g] for g, tf in c.items() if g in idf}
        length = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / length for g, w in v.items()}

    left, right = ([unit(c) for c in side] for side in counted)
    found = ((i, j, sum(w * y[g] for g, w in x.items() if g in y)) for i, x in enumerate(left) if x for j, y in enumerate(right))
    return [(i, j, c) for i, j, c in found if c >= least - 1e-12]


def _alike(a: DataFrame, b: DataFrame, group: Sequence[str], key_a: str, key_b: str, text: str, least: float, blended: float | None = None) -> DataFrame:
    """(group, key_a, key_b, cosine, similarity): all pairs whose cosine is ``least`` and, if given, whose blend is ``blended`` or more."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    a, b = (t.select(*group, k, text).dropna() for t, k in ((a, key_a), (b, key_b)))
    count = lambda t, name: t.groupBy(*group).agg(F.count(F.lit(1)).alias(name))

    def compare(x: list[str], y: list[str]) -> Iterator[tuple[int, int, float, float]]:
        for i, j, cosine in _of_group(x, y, least):
            like = 1.0 if blended is None else blend(x[i], y[j], cosine, blended)
            if blended is None or like >= blended:
                yield i, j, cosine, like

    small, large = groups.parted(a, b, group, FEW_PAIRS)
    out = groups.compared(*small, group, key_a, key_b, text, compare, ["cosine", "similarity"])
    if large is None:
        return out
    a, b = large
    ta, tb = (distinct_texts(t, group, text) for t in (a, b))
    idf = fitted(tb, group, text)
    va, vb = (vectors(t, idf, group, text).withColumnRenamed("id", k) for t, k in ((ta, "i"), (tb, "j")))
    near = stored(shared_sums(va, vb, least - 1e-12).select(F.col("i").alias("_i"), F.col("j").alias("_j"), "total", F.lit(1.0).alias("similarity")), "near")
    if blended is not None:
        texts = near.join(ta.select(F.col("id").alias("_i"), F.col(text).alias("_a")), "_i").join(tb.select(F.col("id").alias("_j"), F.col(text).alias("_b")), "_j")
        lengths = F.least(F.length("_a"), F.length("_b")) / F.greatest(F.length("_a"), F.length("_b"))
        texts = texts.filter(COSINE_SHARE * F.col("total") + RATIO_SHARE * lengths >= blended - 1e-9)

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series, cosine: pd.Series) -> pd.Series:
            return pd.Series(np.array([blend(*row, blended) for row in zip(x, y, cosine, strict=True)], np.float64))

        near = stored(texts.select("_i", "_j", "total", run("_a", "_b", "total").alias("similarity")).filter(F.col("similarity") >= blended), "alike")
    keyed = lambda t, texts, key, name: t.join(texts.select(*group, text, F.col("id").alias(name)), [*group, text]).select(*group, key, name)
    rows = near.join(keyed(a, ta, key_a, "_i"), "_i").join(keyed(b, tb, key_b, "_j").drop(*group), "_j")
    return out.union(rows.select(*group, key_a, key_b, F.col("total").alias("cosine"), "similarity"))


def cosine_pairs(a: DataFrame, b: DataFrame, group: Sequence[str], key_a: str, key_b: str, text: str, least: float) -> DataFrame:
    """(group, key_a, key_b, cosine): all pairs of one group whose cosine is ``least`` (over 0) or more; the weights are fitted on ``b``.

    A group of few pairs is compared within a task. Of larger ones the different texts meet in blocks (see
    ``shared_sums``), so neither a gram nor a group gathers rows and no pair is shuffled but those found.
    Keys are those of one row in its group. Null groups, keys and blank texts match nothing.
    """
    return _alike(a, b, group, key_a, key_b, text, least).drop("similarity")


def part_ratio(a: str, b: str, over: float = 0.0) -> float:
    """The best Indel ratio (0 to 100) of the shorter text to a stretch of the longer one that is no longer, at its ends also
    shorter; ``over`` if none has more than that.

    A stretch's subsequence has no more characters than both have in common in any order, which are counted
    as the stretch moves on: only a stretch that can be better by them is looked at.
    """
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return max(over, 100.0 if not b else 0.0)
    if a in b:
        return 100.0
    best = over
    for text, other in ((a, b), (b, a)) if n == len(b) else ((a, b),):
        left = Counter(text)  # of each character what the stretch has not yet; negative where it has too many
        common, found = 0, []
        for end in range(1, len(other) + n):
            if end <= len(other):
                c = other[end - 1]
                k = left.get(c, 0)
                common += k > 0
                left[c] = k - 1
            if end > n:
                c = other[end - n - 1]
                k = left[c]
                common -= k >= 0
                left[c] = k + 1
            low, high = max(0, end - n), min(end, len(other))
            bound = 200.0 * common / (n + high - low)
            if bound > best:
                found.append((-bound, low, high))
        for bound, low, high in sorted(found):
            if -bound <= best:
                break
            best = max(best, 200.0 * common_length(text, other[low:high]) / (n + high - low))
    return best


text_ratio = lru_cache(100_000)(part_ratio)


def blend(a: str, b: str, cosine: float, least: float = 0.0) -> float:
    """Two normalised descriptions' similarity, 0 to 1: six tenths of the cosine and four of the better of the ratios of
    their sorted words and of the shorter's best place in the longer, reduced by their lengths' ratio. A similarity under
    ``least`` is told as any value under it."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    lengths = min(len(a), len(b)) / max(len(a), len(b))
    # What a stretch has in common with the shorter text are characters of both texts at most.
    common, shorter = sum((Counter(a) & Counter(b)).values()), min(len(a), len(b))
    if COSINE_SHARE * cosine + RATIO_SHARE * lengths * 2 * common / (shorter + common) < least - 1e-9:
        return 0.0
    words = indel_ratio(sorted_words(a), sorted_words(b))
    needed = 100.0 * (least - COSINE_SHARE * cosine) / (RATIO_SHARE * lengths) - 1e-6
    ratio = part_ratio(a, b, needed) if needed > words else text_ratio(a, b, words)
    return COSINE_SHARE * cosine + RATIO_SHARE * ratio * lengths / 100.0


def similar_pairs(a: DataFrame, b: DataFrame, group: Sequence[str], key_a: str, key_b: str, text: str, least: float = MATCH) -> DataFrame:
    """(group, key_a, key_b, cosine, similarity): all pairs of one group whose blend is ``least`` or more.

    ``least`` must be over the ratio's share: such pairs have a cosine of what the ratio cannot give at least, and
    with their lengths' ratio still more, so ratios are taken of few pairs. Texts come normalised; blank ones match nothing.
    """
    if least <= RATIO_SHARE:
        raise ValueError("least must be over the ratio's share")
    return _alike(a, b, group, key_a, key_b, text, (least - RATIO_SHARE) / COSINE_SHARE, least)
