"""SimHash near duplicates, compared as vertical bit planes.

A fingerprint's bits are majority votes of its shingles' hashes. Distances are never taken pair by pair:
64 fingerprints lie side by side, bit k of all of them in one 64-bit word (plane k). For a fingerprint q,
``plane ^ q's bit`` marks who differs in bit k; carry-save adders sum these marks in counters that are
themselves bit planes, so one instruction advances 64 distances. After each eight planes every block of
64 in which all counters exceed the radius is abandoned.

Who is compared with whom: pairs that share a bucket. For few bits of radius the buckets are choices of
disjoint bit fields, so that no pair within the radius is lost (pigeonhole); more rows take finer choices.
For a wide radius they are random bit sets, as many as a stated recall needs. Equal fingerprints are one node. Large buckets are
cut into tiles and compared tile against tile, so no task holds a bucket.

Where texts and not fingerprints decide, a wide radius only proposes pairs, the nearest first, and the texts'
shingle sets are compared before a pair counts as a link. Where a proposal is refused, all pairs of its group
are compared by their sets.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidied, utf8, whole, whole_groups
from .components import components

SEED = 42
#: Members of a bucket that one tile holds.
TILE = 1024
#: So many large buckets or fewer (12 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_BUCKETS = 500_000
_GOLDEN = 0x9E3779B97F4A7C15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than ASCII white space."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, joined by spaces; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """The fingerprint, ``n_words`` 64-bit words: bit 1 where over half of the hashes have it; zero without hashes.

    The first word votes with the hashes themselves, each further word with a remix of them.
    """
    votes = np.zeros(64 * n_words, np.int64)
    for begin in range(0, len(hashes), 32_768):
        part = hashes[begin : begin + 32_768]
        for k in range(n_words):
            h = part
            if k:
                h = part + np.uint64(k * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            bits = np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def fingerprints(documents: DataFrame, shingle: int = 4, n_words: int = 1, distinct: bool = False, id_column: str = "doc_id", text_column: str = "text", carried: Sequence[str] = (), with_sets: bool = False) -> DataFrame:
    """(id, f0, f1, ...): each document's fingerprint as longs, bit for bit. Null and empty texts: zero.

    With ``distinct`` repeated shingles vote once. ``carried``: columns of longs that come along. ``with_sets``:
    a last column ``shingles``, the distinct 32-bit hashes of the text's shingles in ascending order.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"), *carried)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sets = np.empty((batch.num_rows, n_words), np.uint64), []
            for k, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(words_of(text.as_py()), shingle)
                if distinct:
                    hashes = np.unique(hashes)
                out[k] = majority(hashes, n_words)
                if with_sets:
                    sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            columns = [pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(n_words)]
            last = [pa.array(sets, pa.binary())] if with_sets else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:], *last], names=[*names, "shingles"] if with_sets else names)

    names = ["id", *(f"f{k}" for k in range(n_words)), *carried]
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + (", shingles binary" if with_sets else ""))


def exact_masks(radius: int, n_rows: int) -> list[list[int]]:
    """Masks of one word such that two words within the radius agree under one of them at least.

    Of radius + m disjoint bit fields such words agree on m at least: there is a mask for each choice of m.
    m is the smallest for which evenly spread rows fill a bucket with one tile at most.
    """
    m = 1
    while n_rows / 2 ** (64 * m / (radius + m)) > TILE:
        m += 1
    edges = [round(64 * k / (radius + m)) for k in range(radius + m + 1)]
    fields = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [[sum(chosen)] for chosen in combinations(fields, m)]


def sampled_masks(n_words: int, distance_share: float, miss: float, n_rows: int) -> list[list[int]]:
    """Masks of random bit sets: a pair that differs in ``distance_share`` of the bits shares none with probability ``miss``.

    A set has about log2(rows) - 6 bits, so buckets stay small at any size; more bits take more sets.
    """
    bits = max(10, math.ceil(math.log2(max(2, n_rows))) - 6)
    sets = math.ceil(math.log(miss) / math.log1p(-((1 - distance_share) ** bits)))
    draw, masks = random.Random(SEED), []
    for _ in range(sets):
        mask = [0] * n_words
        for b in draw.sample(range(64 * n_words), bits):
            mask[b // 64] |= 1 << (b % 64)
        masks.append(mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_keys(masks: list[list[int]]) -> Column:
    keys = [F.xxhash64(F.lit(t), *(F.col(f"f{k}").bitwiseAND(F.lit(_signed(m)).cast("long")) for k, m in enumerate(mask))) for t, mask in enumerate(masks)]
    return F.explode(F.array(*keys)).alias("bucket")


def _units(rows: DataFrame, tiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(unit, side, rep, columns): ``rows`` (bucket, rep, ...) dealt to units, one for each tile of a bucket and for each two of its tiles.

    ``tiles``: (bucket, tiles), the number of tiles of a bucket. Side 2: a tile by itself; 0 and 1: two tiles.
    """
    large = stored(tiles.filter("tiles > 1").select("bucket", "tiles"), "large")
    few = large.count() <= BROADCAST_BUCKETS
    tiled = rows.join(F.broadcast(large) if few else large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return tiled.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
        "rep",
        *columns,
    )


def near_edges(nodes: DataFrame, levels: Sequence[int], masks: list[list[int]], n_words: int = 1) -> DataFrame:
    """(a, b, level): links between ``nodes`` (rep, f0, ...) that span, in each tile, the same groups as all pairs within the radius.

    ``levels``: ascending distances, the last one the radius. A tile's links come as a forest, at most one
    row for each member, however many pairs there are; each is a pair within its level, and pairs of a lower
    level are taken first.
    """
    words = [f"f{k}" for k in range(n_words)]
    rows = nodes.select("rep", *words, _bucket_keys(masks))
    tiles = nodes.select(*words, _bucket_keys(masks)).groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    units = _units(rows, tiles, words)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 16_384):
            prints = np.stack([table.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
            rep = table.column("rep").to_numpy()
            a, b, level = forest(table.column("unit").to_numpy(), table.column("side").to_numpy(), prints, levels)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b]), pa.array(level, pa.int32())], names=["a", "b", "level"])

    return units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "a long, b long, level int")


def forest(unit: np.ndarray, side: np.ndarray, prints: np.ndarray, levels: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (a, b) and levels of a spanning forest of the links within the last level; rows are sorted by unit and side.

    Side 2: all of the unit are compared; sides 0 and 1: those of 0 with those of 1.
    """
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[starts[1:], len(unit)]
    ones = np.add.reduceat(side == 0, starts)
    many = (ends - starts > 1) & ((side[starts] == 2) | ((ones > 0) & (ones < ends - starts)))
    starts, ends, ones = starts[many], ends[many], ones[many]
    within = side[starts] == 2
    label = np.arange(len(unit))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    t_begin, q_end = np.where(within, starts, starts + ones), np.where(within, ends, starts + ones)
    n_words = -(-(ends - t_begin) // 64)
    first_word = np.r_[0, np.cumsum(n_words)]
    # Lanes: each unit's targets, padded to whole words.
    sizes = ends - t_begin
    source = np.repeat(t_begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    lane = np.repeat(64 * first_word[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    row_of = np.full(64 * first_word[-1], -1)
    row_of[lane] = source
    padded = np.zeros((64 * first_word[-1], prints.shape[1]), np.uint64)
    padded[lane] = prints[source]
    planes = _planes(padded)
    valid = np.packbits(row_of >= 0, bitorder="little").view("<u8")
    # Pairs of a query row and a word of its unit.
    n_queries = q_end - starts
    per = n_queries * n_words
    total = np.r_[0, np.cumsum(per)]
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for radius in levels:
        for begin in range(0, int(total[-1]), 1 << 16):
            k = np.arange(begin, min(int(total[-1]), begin + (1 << 16)))
            u = np.searchsorted(total, k, "right") - 1
            within_unit = k - total[u]
            q, w = starts[u] + within_unit // n_words[u], first_word[u] + within_unit % n_words[u]
            later = ~within[u] | (row_of[64 * w] >= 0) & (t_begin[u] + 64 * (w - first_word[u]) + 63 > q)
            q, w = q[later], w[later]
            q, w, hits = near_lanes(prints, planes, valid, q, w, radius)
            if not len(q):
                continue
            lanes = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(lanes)
            found.append((*_hook(label, q[at], row_of[64 * w[at] + bit]), radius))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate([f[side] for f in found]) for side in (0, 1))
    return a, b, np.repeat([f[2] for f in found], [len(f[0]) for f in found])


def _planes(prints: np.ndarray) -> np.ndarray:
    """(bits, words): word j of plane k holds bit k of fingerprints 64 j to 64 j + 63."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_lanes(prints: np.ndarray, planes: np.ndarray, valid: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (query, word) pairs that keep a lane within the radius, and these lanes' marks."""
    n_bits = prints.shape[1] * 64
    high = max(1, (n_bits // 8).bit_length())
    ones, twos, fours = (np.zeros(len(q), np.uint64) for _ in range(3))
    eights = [np.zeros(len(q), np.uint64) for _ in range(high)]
    alive = valid[w]
    for group in range(0, n_bits, 8):
        marks = []
        for bit in range(group, group + 8):
            flip = (np.uint64(0) - ((prints[q, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1))).astype(np.uint64)
            marks.append(planes[bit][w] ^ flip)
        two = []
        for k in range(0, 8, 2):
            ones, carry = _add3(ones, marks[k], marks[k + 1])
            two.append(carry)
        twos, four_a = _add3(twos, two[0], two[1])
        twos, four_b = _add3(twos, two[2], two[3])
        fours, carry = _add3(fours, four_a, four_b)
        for k in range(high):
            eights[k], carry = eights[k] ^ carry, eights[k] & carry
        alive &= ~_over([ones, twos, fours, *eights], radius)
        kept = np.flatnonzero(alive)
        if not len(kept):
            return q[:0], w[:0], alive[:0]
        if len(kept) < 0.8 * len(q):
            q, w, alive, ones, twos, fours = (x[kept] for x in (q, w, alive, ones, twos, fours))
            eights = [x[kept] for x in eights]
    kept = np.flatnonzero(alive)
    return q[kept], w[kept], alive[kept]


def _add3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three bit vectors: sums and carries."""
    both = a ^ b
    return both ^ c, (a & b) | (both & c)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Marks of the lanes whose counter (least bit first) exceeds the radius."""
    over, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            over |= equal & counter[k]
            equal = equal & ~counter[k]
    return over


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of linked rows; a group's label is its smallest row."""
    _hook(label, a, b)


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the groups of linked rows; those of the links (a, b) that did it, a forest."""
    kept_a, kept_b = [a[:0]], [b[:0]]
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return np.concatenate(kept_a), np.concatenate(kept_b)
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        # Each group with a smaller one beside it joins the first such: labels only fall, so no circle closes.
        high, first = np.unique(np.maximum(la, lb), return_index=True)
        label[high] = np.minimum(la, lb)[first]
        kept_a.append(a[first])
        kept_b.append(b[first])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def near_duplicates(
    documents: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    n_words: int = 1,
    miss: float = 0.0,
    distinct: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, f0, ..., component): each document's fingerprint and the smallest id it is linked to, directly or not.

    ``n_words``: 64-bit words of a fingerprint; ``radius``: most differing bits of a link. With ``miss`` 0
    (one word only) no link is lost; else a link at the radius is missed with that probability.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal ids are one
    document to the groups, each row kept. A null id: the row takes the smallest id linked to it, null if
    there is none. An empty table gives an empty result. Other columns are ignored.
    """
    words = [f"f{k}" for k in range(n_words)]
    prints = stored(fingerprints(documents, shingle, n_words, distinct, id_column, text_column), "prints")
    nodes = stored(prints.groupBy(*words).agg(F.min("id").alias("rep")), "nodes")
    known = nodes.filter("rep is not null")
    n_nodes = nodes.count()
    masks = sampled_masks(n_words, radius / (64 * n_words), miss, n_nodes) if miss else exact_masks(radius, n_nodes)
    own = prints.join(nodes.withColumnRenamed("rep", "b"), words).select(F.col("id").alias("a"), "b") if prints.groupBy("id").count().filter("count > 1").limit(1).count() else None
    edges = near_edges(known, [radius], masks, n_words).select("a", "b")
    if own is not None:
        # Rows that share an id join the groups of their fingerprints.
        edges = edges.union(own)
    groups = components(edges)
    mapped = stored(nodes.join(groups, F.col("rep") == F.col("node"), "left").select(*words, F.coalesce("component", "rep").alias("component")), "groups")
    return prints.join(mapped, words).select("id", *words, "component")


def hex_fingerprint(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


#: For whole shingle sets of five words: texts that share 0.8 of their shingles differ in about 39 of 256 bits, give or
#: take 6. Pairs of 56 bits or less are proposed; of those of 44 bits 1 in 50 shares no bucket.
SHINGLE, SIMILARITY, WORDS = 5, 0.8, 4
LEVELS, BUCKET_DISTANCE, MISS = (32, 44, 50, 56), 44, 0.02
#: Nodes, and bytes of their sets, that one tile of a group of proposals holds.
SET_ROWS, SET_BYTES = 2048, 2 << 20


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, as ascending arrays, have a Jaccard similarity of ``least`` or more; two empty ones do."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    shared = len(np.intersect1d(x, y, assume_unique=True)) if small >= least * large else 0
    return shared >= least * (small + large - shared)


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): those of the pairs (a, b) whose sets (rep, shingles) have a Jaccard similarity of ``least`` or more; two empty sets are equal."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def compared(proposed: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links, refused): of the proposed pairs (a, b, level), links (a, b) that span the same groups as all similar ones, and those found unlike.

    Each node's nearest proposal is compared first; of the others only those whose ends the links so far
    leave apart.
    """
    ends = proposed.select(F.col("a").alias("node"), "level", "a", "b").union(proposed.select(F.col("b"), "level", "a", "b"))
    nearest = stored(ends.groupBy("node").agg(F.min(F.struct("level", "a", "b")).alias("n")).select("n.a", "n.b").distinct(), "nearest")
    first = stored(similar(nearest, sets, least), "links")
    groups = stored(components(first), "groups")
    group_of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    apart = proposed.select("a", "b").distinct().join(nearest, ["a", "b"], "left_anti").join(group_of("a"), "a", "left").join(group_of("b"), "b", "left")
    apart = stored(apart.filter(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b"), "apart")
    links = stored(first.union(similar(apart, sets, least)), "links")
    refused = stored(nearest.union(apart).join(links, ["a", "b"], "left_anti"), "refused")
    for table in (nearest, first, groups, apart):
        forget(table)
    return links, refused


def alike_forest(side: np.ndarray, sets: list[np.ndarray], joined: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Row numbers (a, b) of links that, with the ``joined`` groups, span the same groups as all similar pairs of a unit.

    Side 2: all of the unit are compared; sides 0 and 1, in that order: those of 0 with those of 1. A set also
    stands as a row of bits, its members' hashes: sets differ in at least as many members as their rows in bits,
    so pairs whose rows differ in too many cannot be similar, and only the others' sets are compared.
    """
    _, first, of = np.unique(joined, return_index=True, return_inverse=True)
    label = first[of]
    if len(first) == 1:
        return []
    sizes = np.array([len(s) for s in sets])
    n_bits = 64 * min(1024, max(8, int(sizes.mean()) // 4))
    marks = np.zeros((len(sets), n_bits), bool)
    marks[np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) % n_bits] = True
    marks = np.packbits(marks, axis=1).view(np.uint64)
    ones = int((side == 0).sum())
    found = []
    for k in range(ones or len(sets)):
        begin = max(k + 1, ones)
        rest = begin + np.flatnonzero(label[begin:] != label[k])
        # Similar sets differ in at most this many members.
        most = (sizes[rest] + sizes[k]) * (1 - least) / (1 + least) + 1e-6
        near = np.abs(sizes[rest] - sizes[k]) <= most
        rest, most = rest[near], most[near]
        differ = np.bitwise_count(marks[rest] ^ marks[k]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(differ <= most)
        rest = rest[near[np.argsort(differ[near], kind="stable")]]
        while len(rest):
            other, rest = rest[0], rest[1:]
            if alike(sets[k], sets[other], least):
                _hook(label, np.array([k]), np.array([other]))
                found.append((k, int(other)))
                rest = rest[label[rest] != label[k]]
    return found


def alike_within(nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links between ``nodes`` (rep, home, joined, shingles) that, with the ``joined`` groups, span the same groups as all similar pairs of one ``home``."""
    rows = nodes.withColumnRenamed("home", "bucket")
    tiles = rows.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / SET_ROWS, F.sum(F.length("shingles")) / SET_BYTES)).cast("int").alias("tiles"))
    units = _units(rows, tiles, ["joined", "shingles"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 1):
            unit, side, rep, joined = (table.column(c).to_numpy() for c in ("unit", "side", "rep", "joined"))
            sets = [np.frombuffer(s.as_buffer(), "<u4") for s in table.column("shingles")]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            links = [(begin + a, begin + b) for begin, end in zip(starts, np.r_[starts[1:], len(unit)], strict=True) for a, b in alike_forest(side[begin:end], sets[begin:end], joined[begin:end], least)]
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "a long, b long")


def verified_groups(proposed: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, component) of the links that the nodes' sets confirm.

    Proposals come as forests, so a refused one may have stood before a similar pair that it joined already.
    Where a group of proposals has a refused one, all pairs of its nodes are therefore compared by their sets,
    but for those that links join already. So the nodes of one group of proposals are grouped as by all similar
    pairs of them, however many were refused.
    """
    links, refused = compared(proposed, sets, least)
    tables = [links, refused]
    if refused.limit(1).count():
        home = stored(components(proposed.select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("home")), "home")
        groups = stored(components(links).select(F.col("node").alias("rep"), F.col("component").alias("joined")), "groups")
        doubtful = refused.select(F.col("a").alias("rep")).join(home, "rep").select("home").distinct()
        opened = home.join(doubtful, "home", "left_semi").join(groups, "rep", "left").withColumn("joined", F.coalesce("joined", "rep"))
        opened = stored(opened.join(sets, "rep").select("rep", "home", "joined", "shingles"), "opened")
        more = stored(alike_within(opened, least), "links")
        tables += [home, groups, opened, more]
        links = links.union(more)
    out = stored(components(links), "groups")
    for table in tables:
        forget(table)
    return out


def first_of_each_group(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, without all but one row of each group of linked texts.

    Texts are linked where their sets of ``shingle`` words have a Jaccard similarity of ``least`` or more;
    those with equal fingerprints of 256 bits count as equal. Texts are linked, not ids: of a group the row
    of the smallest id stays, null ids last, and of rows with that id the one of the smallest hash of its
    text. So rows that share an id, or have none, all stay where their texts are not linked. Null and empty
    texts are equal to each other.
    """
    keys = ["_id", "_text1", "_text2"]
    words = [f"f{k}" for k in range(WORDS)]
    keyed = documents.select(whole(documents), F.col(id_column).cast("long").alias("_id"), F.xxhash64(text_column).alias("_text1"), F.xxhash64(F.lit(1), text_column).alias("_text2"))
    read = keyed.select("_id", F.col("document")[text_column].alias("text"), *keys[1:])
    prints = stored(fingerprints(read, shingle, WORDS, True, "_id", "text", keys[1:], with_sets=True).withColumnRenamed("id", "_id"), "prints")
    order = F.struct(F.col("_id").isNull().alias("no_id"), *keys)
    nodes = stored(prints.groupBy(*words).agg(F.min(order).alias("first")).withColumn("rep", F.monotonically_increasing_id()), "nodes")
    masks = sampled_masks(WORDS, BUCKET_DISTANCE / (64 * WORDS), MISS, nodes.count())
    proposed = stored(near_edges(nodes, LEVELS, masks, WORDS), "proposed")
    asked = proposed.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = stored(prints.select(*words, "shingles").join(nodes.join(asked, "rep", "left_semi").select(*words, "rep"), words).dropDuplicates(words).select("rep", "shingles"), "sets")
    found = verified_groups(proposed, sets, least)
    groups = found.withColumnRenamed("node", "rep")
    firsts = nodes.join(groups, "rep").groupBy("component").agg(F.min("first").alias("group_first"))
    moved = groups.join(firsts, "component").select("rep", "group_first")
    mapped = stored(nodes.join(moved, "rep", "left").select(*words, F.coalesce("group_first", "first").alias("first")), "firsts")
    own = prints.select(*words, *keys)
    gone = stored(own.join(mapped, words).filter(order != F.col("first")).select(*(F.col(c).alias(f"{c}_gone") for c in keys)).distinct(), "gone")
    repeated = own.groupBy(*keys).count().filter("count > 1").limit(1).count()
    for table in (prints, nodes, proposed, sets, found, mapped):
        forget(table)
    kept = keyed.join(gone, [F.col(c).eqNullSafe(F.col(f"{c}_gone")) for c in keys], "left_anti")
    if repeated:
        kept = kept.dropDuplicates(keys)
    return kept.select("document.*")
