"""Record linkage: exact pairing, tiered lookups, prefix candidates, unit rules."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel, indel_ratio
from ..functions.text import confused_places, scan_key
from . import groups
from .storage import forget, stored


def paired_in_order(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Full outer pairs of equal keys: the first of ``a`` with the first of ``b``, the second with the second.

    Both sides keep all columns, as structs ``a`` and ``b`` (null where unmatched); null keys match nothing.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    turn = lambda t, name: t.withColumn("_turn", F.row_number().over(w)).select(*keys, "_turn", F.struct(*t.columns).alias(name))
    return turn(a, "a").join(turn(b, "b"), [*keys, "_turn"], "full")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given; the row limit runs before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def two_tier(items: DataFrame, master: DataFrame, exact: tuple[str, str], loose: tuple[str, str], item_id: str) -> DataFrame:
    """Items with their master row (struct ``m``) and ``tier``: by the exact key, else by the loose one, else none.

    Of several master rows of one key the smallest exact key is taken.
    """
    by_exact = master.groupBy(F.col(exact[1]).alias("_exact")).agg(F.min(F.struct(F.col(exact[1]).alias("_first"), *master.columns)).alias("me"))
    by_loose = master.groupBy(F.col(loose[1]).alias("_loose")).agg(F.min(F.struct(F.col(exact[1]).alias("_first"), *master.columns)).alias("ml"))
    first = items.join(by_exact, items[exact[0]] == F.col("_exact"), "left")
    both = first.join(by_loose, first[loose[0]] == F.col("_loose"), "left")
    tier = F.when(F.col("me").isNotNull(), "exact").when(F.col("ml").isNotNull(), "loose").otherwise("none")
    return both.select(*items.columns, F.coalesce("me", "ml").alias("m"), tier.alias("tier"))


def prefix_candidates(items: DataFrame, item_key: str, master: DataFrame, master_key: str) -> DataFrame:
    """Item rows joined to the master rows whose key is the item's key and digits after it.

    A master key is sent once for each of its beginnings that only digits follow, so the sides meet on whole
    keys; no stem that many keys share gathers them.
    """
    digits = F.length(F.regexp_extract(F.col(master_key), "([0-9]*)$", 1))
    begins = F.transform(F.sequence(F.lit(0), digits), lambda n: F.substr(F.col(master_key), F.lit(1), F.length(master_key) - n))
    return items.join(master.withColumn("_begin", F.explode(begins)), F.col(item_key) == F.col("_begin")).drop("_begin")


def match_status(candidates: Column) -> Column:
    return F.when(candidates == 1, "matched").when(candidates > 1, "ambiguous").otherwise("unmatched")


def unit_factor(rows: DataFrame, rules: DataFrame, ref: str, unit_from: str, unit_to: str, row_id: str) -> DataFrame:
    """The rows with ``factor``: of the rules (ref or *, unit_from, unit_to, factor) the item's own first, then forward before inverse.

    Zero factors do not count; there is no chain of rules.
    """
    usable = rules.filter(F.coalesce("factor", F.lit(0.0)) != 0)
    forward = usable.select(F.col("ref").alias("_ref"), F.col("unit_from").alias("_from"), F.col("unit_to").alias("_to"), F.col("factor").alias("_factor"), F.lit(0).alias("_way"))
    inverse = usable.select(F.col("ref"), F.col("unit_to"), F.col("unit_from"), 1 / F.col("factor"), F.lit(1))
    every = forward.union(inverse)
    best = lambda r, prefix: r.groupBy(*(F.col(c).alias(prefix + c) for c in r.columns if c in ("_ref", "_from", "_to"))).agg(F.min(F.struct("_way", "_factor")).alias(prefix))
    own, common = best(every.filter("_ref <> '*'"), "o"), best(every.filter("_ref = '*'").drop("_ref"), "c")
    out = rows.join(own, (F.col(ref) == F.col("o_ref")) & (F.col(unit_from) == F.col("o_from")) & (F.col(unit_to) == F.col("o_to")), "left")
    out = out.join(common, (F.col(unit_from) == F.col("c_from")) & (F.col(unit_to) == F.col("c_to")), "left")
    factor = F.when(F.col(unit_from) == F.col(unit_to), 1.0).otherwise(F.coalesce("o._factor", "c._factor"))
    return out.select(*rows.columns, factor.alias("factor"))


#: Candidates in all that may be paired by one pass over their groups.
FEW_CANDIDATES = 200_000


def greedy_pairs(candidates: DataFrame, group: str, a: str, b: str, score: str, few: int = FEW_CANDIDATES, by_keys: bool = False) -> DataFrame:
    """One-to-one pairs of each group: the best score first, ties by a hash of the pair (not with ``by_keys``), then by a and b.

    In each round the pairs that are best for both their sides are taken and all that share a side with them
    go; equal scores stand in random order, so a logarithmic number of rounds is expected. Groups and sides
    may be of any size: no group meets in one task, until at most ``few`` candidates are left in all.
    A null group, side or score pairs with nothing.
    """
    rows = candidates.select(group, a, b, F.col(score).cast("double").alias(score)).dropna()
    left = stored(rows.withColumn("_tie", F.lit(0).cast("long") if by_keys else F.xxhash64(group, a, b)).distinct(), "candidates")
    rank = lambda other: F.min(F.struct((-F.col(score)).alias("_low"), "_tie", F.col(other))).alias("_best")
    taken = []
    while left.count() > few:
        best_a = left.groupBy(group, a).agg(rank(b)).select(group, a, F.col(f"_best.{b}").alias(b), (-F.col("_best._low")).alias(score))
        best_b = left.groupBy(group, b).agg(rank(a)).select(group, F.col(f"_best.{a}").alias(a), b)
        mutual = stored(best_a.join(best_b, [group, a, b]), "pairs")
        taken.append(mutual.select(group, a, b, score))
        left = stored(left.join(mutual.select(group, a), [group, a], "left_anti").join(mutual.select(group, b), [group, b], "left_anti"), "candidates")
    last = _streamed(left.repartition(group).sortWithinPartitions(group, F.desc(score), "_tie", a, b), group, a, b, score)
    return reduce(DataFrame.union, taken, last)


def ordered_pairs(candidates: DataFrame, group: str, a: str, b: str, score: str, few: int = FEW_CANDIDATES) -> DataFrame:
    """One-to-one pairs of each group: each ``a``, from the smallest on, takes the best ``b`` still free; ties go to the smallest ``b``.

    In each round those take their best that no smaller ``a`` could still want it from; the smallest of a group
    always does. Groups may be of any size: none meets in one task, until at most ``few`` candidates are left in all.
    A null group, side or score pairs with nothing.
    """
    left = stored(candidates.select(group, a, b, F.col(score).cast("double").alias(score)).dropna().distinct(), "candidates")
    taken = []
    while left.count() > few:
        best = left.groupBy(group, a).agg(F.min(F.struct((-F.col(score)).alias("_low"), F.col(b))).alias("_best")).select(group, a, F.col(f"_best.{b}").alias(b), (-F.col("_best._low")).alias(score))
        first = left.groupBy(group, b).agg(F.min(a).alias(a))
        sure = stored(best.join(first, [group, a, b]), "pairs")
        taken.append(sure.select(group, a, b, score))
        fresh = stored(left.join(sure.select(group, a), [group, a], "left_anti").join(sure.select(group, b), [group, b], "left_anti"), "candidates")
        forget(left)
        left = fresh
    last = _streamed(left.repartition(group).sortWithinPartitions(group, a, F.desc(score), b), group, a, b, score)
    return reduce(DataFrame.union, taken, last)


def _streamed(ordered: DataFrame, group: str, a: str, b: str, score: str) -> DataFrame:
    """The pairs, in the order of the rows within their group, whose sides are both still free."""
    kinds = {c: ordered.schema[c].dataType.simpleString() for c in (group, a, b)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_a, used_b = None, set(), set()
        for batch in batches:
            kept = []
            for g, x, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if g != now:
                    now, used_a, used_b = g, set(), set()
                kept.append(x not in used_a and y not in used_b)
                if kept[-1]:
                    used_a.add(x)
                    used_b.add(y)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ordered.select(group, a, b, score).mapInArrow(pick, f"{group} {kinds[group]}, {a} {kinds[a]}, {b} {kinds[b]}, {score} double")


def _first_tokens(least: float) -> Callable[[pd.Series], pd.Series]:
    """For each text the characters, numbered by their occurrence, of which another text of the ratio must share one.

    Two texts of ratio r or more have at least n r / (2 - r) characters in common, n the length of either. In one
    order of all numbered characters (late occurrences first) the first n - that + 1 of both then share one.
    """
    share = least / (200.0 - least)

    def tokens(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            seen: dict[str, int] = {}
            numbered = []
            for c in t:
                seen[c] = seen.get(c, 0) + 1
                numbered.append((-seen[c], c))
            first = len(t) - math.ceil(len(t) * share - 1e-9) + 1
            out.append([f"{c}{-n}" for n, c in sorted(numbered)[:first]] or [""])
        return pd.Series(out, dtype=object)

    return tokens


def fuzzy_candidates(a: DataFrame, b: DataFrame, group: str, key: str, least: float) -> DataFrame:
    """(group, a, b, score): all pairs of one group whose keys' Indel ratio is ``least`` (over 0, to 100) or more.

    Pairs meet on a numbered character that such pairs must share (see ``_first_tokens``) and on nearby
    lengths, so no pair of the ratio is missed and a group is not crossed with itself, unless it has few pairs. Null keys or groups match nothing.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be over 0 and at most 100")
    near = (F.length("a") * least <= F.length("b") * (200.0 - least)) & (F.length("b") * least <= F.length("a") * (200.0 - least))
    a, b = (t.select(group, F.col(key).alias(name)).dropna().distinct().withColumn("_text", F.col(name)) for t, name in ((a, "a"), (b, "b")))

    def compare(x: list[str], y: list[str]) -> Iterator[tuple[int, int, float]]:
        for i, t in enumerate(x):
            for j, u in enumerate(y):
                if len(t) * least <= len(u) * (200.0 - least) and len(u) * least <= len(t) * (200.0 - least) and (score := indel_ratio(t, u)) >= least:
                    yield i, j, score

    small, large = groups.parted(a, b, [group])
    found = groups.compared(*small, [group], "a", "b", "_text", compare, ["score"])
    if large is None:
        return found
    first = F.pandas_udf(_first_tokens(least), "array<string>")
    side = lambda t, name: t.select(group, name, F.explode(first(name)).alias("_token"))
    pairs = side(large[0], "a").join(side(large[1], "b"), [group, "_token"]).filter(near).select(group, "a", "b").distinct()
    return found.union(pairs.withColumn("score", indel("a", "b")).filter(F.col("score") >= least))


#: Bounds of the ratio between which pairs are sought, and the longest texts that are shortened in every way.
BOUNDS = (90.0, 80.0, 70.0, 60.0, 50.0)
SHORTENED = 40


def _shortened(t: str) -> set[str]:
    """The text without two, one or none of its characters."""
    once = {t[:k] + t[k + 1 :] for k in range(len(t))}
    return {t} | once | {u[:k] + u[k + 1 :] for u in once for k in range(len(u))}


def two_apart(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """(group, a, b, score): all pairs of one group of which two characters at most are not common, and their Indel ratio.

    Such pairs are alike when shortened, and what is left at their longest is their common subsequence.
    """

    @F.pandas_udf("array<string>")
    def shortened(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(_shortened(t)))

    side = lambda t, name: t.select(group, F.col(key).alias(name)).dropna().distinct().select(group, name, F.explode(shortened(name)).alias("_v"))
    left, right = side(a, "a"), side(b, "b").withColumn("_b_lacks", F.length("b") - F.length("_v"))
    # What both lack is two characters at most, so texts meet on what the other lacks too.
    left = left.withColumn("_b_lacks", F.explode(F.sequence(F.lit(0), 2 - F.length("a") + F.length("_v"))))
    met = left.join(right, [group, "_v", "_b_lacks"]).groupBy(group, "a", "b").agg(F.max(F.length("_v")).alias("_common"))
    total = F.length("a") + F.length("b")
    return met.select(group, "a", "b", F.when(total == 0, 100.0).otherwise(F.lit(200.0) * F.col("_common") / total).alias("score"))


def best_fuzzy_pairs(a: DataFrame, b: DataFrame, group: str, key: str, least: float, few: int = FEW_CANDIDATES) -> DataFrame:
    """(group, a, b, score): the pairs that ``greedy_pairs`` takes of all ``fuzzy_candidates``, without making these first.

    The best pairs come first anyhow, so they are sought and taken first, and only what they leave free is
    compared at the next lower bound of the ratio. With a low least ratio nearly all pairs of a group are
    candidates, but hardly any of its texts are still free then.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be over 0 and at most 100")
    free = [stored(t.select(group, key).dropna().distinct(), "free") for t in (a, b)]
    longest = max(t.agg(F.coalesce(F.max(F.length(key)), F.lit(0))).first()[0] for t in free)
    # From this ratio on less than three characters are not common, whatever the lengths.
    near = 100.0 * (1 - 2.999 / (2 * max(longest, 2)))
    short = longest <= SHORTENED
    bounds = sorted({x for x in ((near, *BOUNDS) if short else BOUNDS) if x > least and not (short and x > near)}, reverse=True)
    taken = []
    for bound in [*bounds, least]:
        met = two_apart(*free, group, key).filter(F.col("score") >= bound) if short and bound >= near else fuzzy_candidates(*free, group, key, bound)
        taken.append(stored(greedy_pairs(met, group, "a", "b", "score", few=few), "taken"))
        fresh = [t.join(taken[-1].select(group, F.col(name).alias(key)), [group, key], "left_anti") for t, name in zip(free, "ab", strict=True)]
        fresh[0] = stored(fresh[0].join(free[1].select(group).distinct(), group, "left_semi"), "free")
        fresh[1] = stored(fresh[1].join(fresh[0].select(group).distinct(), group, "left_semi"), "free")
        for t in free:
            forget(t)
        free = fresh
        if not free[0].limit(1).count() or not free[1].limit(1).count():
            break
    return reduce(DataFrame.union, taken)


def candidates_by_trigram(a: DataFrame, b: DataFrame, group: str, key: str, least: float) -> DataFrame:
    """(group, a, b, score): pairs of one group that share three characters in a row and whose ratio is ``least`` or more.

    For long keys, of which nearly all share single characters. Pairs alike without a common trigram are not met.
    """
    grams = lambda t, name: t.select(group, F.col(key).alias(name), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - 2)), lambda i: F.substr(F.col(key), i, F.lit(3))))).alias("gram"))
    pairs = grams(a, "a").join(grams(b, "b"), [group, "gram"]).select(group, "a", "b").distinct()
    return pairs.withColumn("score", indel("a", "b")).filter(F.col("score") >= least)


def missing_refs(a: DataFrame, b: DataFrame, group: str, key: str, least: float = 85.0) -> DataFrame:
    """(group, ref, verdict, partner, score): references of ``a`` that ``b`` has not, judged by the most alike one of ``b``.

    swap: I and 1, or O and 0, exchanged; characters: other scan errors only; typo: alike by ``least`` or
    more; else missing, without partner. Ties take the smallest partner. Repeated references count once.
    """
    own, other = a.select(group, key).dropna().distinct(), b.select(group, key).dropna().distinct()
    absent = own.join(other, [group, key], "left_anti")
    best = fuzzy_candidates(absent, other, group, key, least).groupBy(group, "a").agg(F.min(F.struct((-F.col("score")).alias("low"), F.col("b").alias("partner"))).alias("m"))
    found = absent.join(best.withColumnRenamed("a", key), [group, key], "left").select(group, F.col(key).alias("ref"), F.col("m.partner").alias("partner"), (-F.col("m.low")).alias("score"))
    ref, partner = F.col("ref"), F.col("partner")
    verdict = F.when(partner.isNull(), "missing").when(scan_key(ref) == scan_key(partner), "swap").when(F.size(confused_places(ref, partner)) > 0, "characters").otherwise("typo")
    return found.select(group, "ref", verdict.alias("verdict"), "partner", "score")


#: The least ratios of lines that are changed, and of those that are equal.
CHANGED = 70.0
EQUAL = 95.0


#: Pairs of lines of a group that one task may look at, one by one.
LINE_PAIRS = 1 << 20


def _changed_lines(a: list[str], b: list[str]) -> Iterator[tuple[int, int, float]]:
    """The places of all pairs of two lists of lines whose ratio is ``CHANGED`` or more, and that."""
    counted = [(len(u), Counter(u)) for u in b]
    for i, t in enumerate(a):
        n, own = len(t), Counter(t)
        for j, (m, other) in enumerate(counted):
            least = CHANGED * (n + m) / 200.0 - 1e-9
            # What they have in common, in any order, is no more than the shorter has.
            if min(n, m) < least or sum(min(k, other.get(c, 0)) for c, k in own.items()) < least:
                continue
            if (score := indel_ratio(t, b[j])) >= CHANGED:
                yield i, j, score


def _lines_alike(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """The same of groups that no task looks at whole: (group, a, b, score) of the lines (group, a, line) and (group, b, line)."""
    first = F.pandas_udf(_first_tokens(CHANGED), "array<string>")
    tokens = lambda t, name: t.select(group, name, F.length("line").alias(f"n_{name}"), F.explode(first("line")).alias("token"))
    near = (F.col("n_a") * CHANGED <= F.col("n_b") * (200.0 - CHANGED)) & (F.col("n_b") * CHANGED <= F.col("n_a") * (200.0 - CHANGED))
    met = tokens(a, "a").join(tokens(b, "b"), [group, "token"]).filter(near).select(group, "a", "b").distinct()
    placed = met.join(a.select(group, "a", F.col("line").alias("line_a")), [group, "a"]).join(b.select(group, "b", F.col("line").alias("line_b")), [group, "b"])
    return placed.withColumn("score", indel("line_a", "line_b")).filter(F.col("score") >= CHANGED).select(group, "a", "b", "score")


def matched_lines(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """(group, a, b, status, score) of the lines (group, place, line) of two texts: a and b are places.

    Each line of ``a``, in order, takes the free line of ``b`` most like it, case aside, of a ratio of ``CHANGED`` at least:
    equal from ``EQUAL`` on, else changed; ties go to the earliest. Other lines are only_a or only_b. Lines of any
    length are compared whole. Places are those of one line in its text; null lines are left out.
    """
    side = lambda t: t.select(group, "place", F.lower("line").alias("line")).dropna()
    a, b = stored(side(a), "lines-a"), stored(side(b), "lines-b")
    small, large = groups.parted(a.withColumnRenamed("place", "a"), b.withColumnRenamed("place", "b"), [group], LINE_PAIRS)
    within = groups.compared(*small, [group], "a", "b", "line", _changed_lines, ["score"])
    pairs = stored(ordered_pairs(within if large is None else within.union(_lines_alike(*large, group)), group, "a", "b", "score"), "line-pairs")
    told = pairs.select(group, "a", "b", F.when(F.col("score") >= EQUAL, "equal").otherwise("changed").alias("status"), "score")
    none, nothing = F.lit(None).cast(a.schema["place"].dataType), F.lit(None).cast("double")
    only_a = a.join(pairs.select(group, F.col("a").alias("place")), [group, "place"], "left_anti").select(group, F.col("place").alias("a"), none.alias("b"), F.lit("only_a").alias("status"), nothing.alias("score"))
    only_b = b.join(pairs.select(group, F.col("b").alias("place")), [group, "place"], "left_anti").select(group, none.alias("a"), F.col("place").alias("b"), F.lit("only_b").alias("status"), nothing.alias("score"))
    return told.union(only_a).union(only_b)
