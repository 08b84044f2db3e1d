"""Phrase collocations from a suffix tree that is cut at a few words and built by vertical partitioning.

Word prefixes (one word; where a word alone is too frequent, two, then three) are put in groups that fit a
memory budget. Every suffix, cut at the longest phrase, goes to the group of its prefix, and each group builds
its subtree on its own: leaves in order, the count of a node being the total of the leaves below it.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidied, utf8

LONGEST = 3
LEAST = 10
#: A candidate goes where a longer one around it has at least this percentage of its occurrences.
WITHIN = 50
TOP = 2000
#: Occurrences that the prefixes of one group may have.
GROUP_BUDGET = 1 << 22
#: Bits of the filter of frequent words, the same at every size of input.
FILTER_BITS = 1 << 24
#: At most so many cells of prefixes are told apart when groups are made.
MOST_CELLS = 1 << 20
#: A task hands its leaves on after so many tokens or different words.
TASK_TOKENS = 2_000_000
TASK_WORDS = 500_000

_LETTERS = bytes.maketrans(string.ascii_uppercase.encode() + b"\t.,;:!?\n\x0b\x0c\r", string.ascii_lowercase.encode() + b" ..........")


def tokens(text: bytes) -> list[bytes]:
    """The words in order, lower case, with ``.`` wherever a piece ends."""
    return text.translate(_LETTERS).replace(b".", b" . ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _deeper(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix and one more word."""
    h = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Numbers(dict):
    """Words numbered from 1 in the order met; ``.`` and words that the filter refuses are 0."""

    def __init__(self, lang: str, frequent: np.ndarray | None = None) -> None:
        super().__init__({b".": 0})
        self.seed, self.frequent, self.words, self.hashes = _seed(lang), frequent, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if self.frequent is not None:
            bit = h & (FILTER_BITS - 1)
            if not int(self.frequent[bit >> 6]) >> (bit & 63) & 1:
                self[word] = 0
                return 0
        self[word] = k = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        return k


@dataclass
class Division:
    """How suffixes are dealt: cells of prefix hashes to groups, and the prefixes of each depth that are too frequent."""

    groups: np.ndarray
    heavy: list[np.ndarray]

    def routes(self, leaves: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, depth) of each leaf: the hash and the length of the prefix that decides its group."""
        key = hashes[leaves[:, 0]]
        depth = np.ones(len(leaves), np.int64)
        for k, heavy in enumerate(self.heavy, 1):
            on = (depth == k) & np.isin(key, heavy)
            depth[on] += 1
            key = np.where(on, _deeper(key, hashes[leaves[:, k]]), key)
        return key, depth

    def group(self, key: np.ndarray) -> np.ndarray:
        bits = len(self.groups).bit_length() - 1
        return self.groups[(key >> np.uint64(64 - bits)).astype(np.int64)] if bits else np.zeros(len(key), np.int32)


def _summed(leaves: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal leaves as one, in order of their words' numbers, which are below ``size``."""
    if not len(leaves):
        return leaves, counts
    if size ** leaves.shape[1] < 1 << 63:
        code = leaves[:, 0].astype(np.int64)
        for k in range(1, leaves.shape[1]):
            code = code * size + leaves[:, k]
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    else:
        order = np.lexsort(leaves.T[::-1])
        ordered = leaves[order]
        starts = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)])
    return leaves[order[starts]], np.add.reduceat(counts[order], starts)


def _suffixes(ids: np.ndarray, longest: int) -> np.ndarray:
    """A row for each word: it and the words after it, up to ``longest``, zeros from the end of its piece on."""
    padded = np.r_[ids, np.zeros(longest, ids.dtype)]
    rows = np.stack([padded[k : k + len(ids)] for k in range(longest)], axis=1)[ids > 0]
    for k in range(1, longest):
        rows[rows[:, k - 1] == 0, k] = 0
    return rows


def _words(rows: DataFrame) -> DataFrame:
    """(lang, word, n): every word's occurrences; tasks count before anything is shuffled."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(b".", None)
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) >= TASK_WORDS:
                yield from told()
        yield from told()

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _filter(words: DataFrame, least: int) -> np.ndarray:
    """A bit for the hash of each word of at least ``least`` occurrences; rarer words mostly have none."""
    bit = F.col("h").bitwiseAND(FILTER_BITS - 1)
    found = words.filter(F.col("n") >= least).select(F.shiftright(bit, 6).alias("place"), F.expr(f"shiftleft(1L, cast((h & {FILTER_BITS - 1}) & 63 as int))").alias("bit"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    got = found.groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[got["place"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _blocks(rows: DataFrame, division: Division, frequent: np.ndarray, longest: int, depth: int = 0) -> DataFrame:
    """(group, lang, words, leaves): a block for each group, language and stretch of a task's rows.

    A block holds its different words, blanks between them, and its leaves: rows of word numbers and a count.
    With ``depth``, (key, n) instead: occurrences of the prefixes of that many words whose first are too frequent.
    """
    shared = rows.sparkSession.sparkContext.broadcast((division, frequent))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        division, frequent = shared.value
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        seen = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts) in held.items():
                ids = np.concatenate(parts)
                leaves = _suffixes(ids, longest)
                leaves, counts = _summed(leaves, np.ones(len(leaves), np.int64), len(numbers.words))
                if not len(leaves):
                    continue
                key, deep = division.routes(leaves, np.array(numbers.hashes, np.uint64))
                if depth:
                    on = deep == depth
                    key, back = np.unique(key[on], return_inverse=True)
                    if len(key):
                        n = np.bincount(back, counts[on], len(key)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
                    continue
                group = division.group(key)
                order = np.argsort(group, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0, True])
                names, words, blocks = [], [], []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    mine = leaves[order[a:b]]
                    used = np.unique(mine)
                    used = used[used > 0]
                    place = np.searchsorted(used, mine) + 1
                    place[mine == 0] = 0
                    names.append(int(group[order[a]]))
                    words.append(b" ".join([numbers.words[k] for k in used.tolist()]))
                    blocks.append(np.c_[place, counts[order[a:b]]].astype(np.int32).tobytes())
                for k in range(0, len(names), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 64], pa.int32()), pa.array([lang] * len(names[k : k + 64])), pa.array(words[k : k + 64], pa.binary()), pa.array(blocks[k : k + 64], pa.binary())], names=["group", "lang", "words", "leaves"])
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers, parts = held.get(lang) or held.setdefault(lang, (_Numbers(lang, frequent), []))
                found = tokens(text)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                seen += len(found)
                if seen >= TASK_TOKENS or len(numbers) >= TASK_WORDS:
                    yield from told()
                    seen = 0
        yield from told()

    return rows.mapInArrow(run, "key long, n long" if depth else "group int, lang string, words binary, leaves binary")


def _division(rows: DataFrame, words: DataFrame, frequent: np.ndarray, longest: int, budget: int) -> Division:
    """Cells of prefixes packed, in order, into groups of at most ``budget`` occurrences.

    A prefix of over half the budget is taken apart by its next word, whose pairs are counted in one more pass
    over the texts; so no prefix that is cut shorter than a leaf fills a group. The driver gets one number for
    each cell, and the prefixes that are too frequent: of each depth at most twice the occurrences over the budget.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(64, min(budget, total // int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    while total > budget * (MOST_CELLS // 8):
        budget *= 2
    bits = max(10, (16 * total // budget).bit_length())
    cells = np.zeros(1 << bits, np.int64)
    cell = F.shiftrightunsigned("key", 64 - bits).alias("cell")
    counts, heavy = words.select(F.col("h").alias("key"), "n"), []
    for depth in range(1, longest):
        often = F.col("n") > budget // 2
        got = counts.filter(~often).groupBy(cell).agg(F.sum("n").alias("n")).toPandas()
        np.add.at(cells, got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.int64))
        keys = np.sort(counts.filter(often).select("key").distinct().toPandas()["key"].to_numpy(np.int64).view(np.uint64))
        if depth > 1:
            forget(counts)
        if not len(keys):
            break
        heavy.append(keys)
        if depth + 1 < longest:
            counts = stored(_blocks(rows, Division(np.zeros(1, np.int32), heavy), frequent, longest, depth + 1).groupBy("key").agg(F.sum("n").alias("n")), "prefixes")
    groups, group, full = np.zeros(len(cells), np.int32), 0, 0
    for k, n in enumerate(cells.tolist()):
        if full + n > budget and full:
            group, full = group + 1, 0
        groups[k] = group
        full += n
    return Division(groups, heavy)


def _nodes(blocks: DataFrame, division: Division, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, f): the nodes of ``least`` occurrences or more, each group's subtree built on its own."""
    shared = blocks.sparkSession.sparkContext.broadcast(division)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        division, at = shared.value, None
        trees: dict[str, tuple[_Numbers, list[np.ndarray], list[np.ndarray]]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts, counts) in trees.items():
                leaves, n = _summed(np.concatenate(parts), np.concatenate(counts), len(numbers.words))
                _, deep = division.routes(leaves, np.array(numbers.hashes, np.uint64))
                new = np.zeros(len(leaves), bool)
                new[0] = True
                for k in range(longest):
                    new[1:] |= leaves[1:, k] != leaves[:-1, k]
                    starts = np.flatnonzero(new)
                    f = np.add.reduceat(n, starts)
                    # Groups hold the whole of a node, but for one whose suffixes were dealt by longer prefixes.
                    told = (leaves[starts, k] > 0) & ((f >= least) | (np.maximum.reduceat(deep, starts) > k + 1))
                    rows = leaves[starts[told], : k + 1].tolist()
                    for j in range(0, len(rows), 10_000):
                        phrases = [b" ".join([numbers.words[w] for w in row]) for row in rows[j : j + 10_000]]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()), pa.array([k + 1] * len(phrases), pa.int32()), pa.array(f[told][j : j + 10_000])], names=["lang", "phrase", "words", "f"])
            trees.clear()

        for batch in batches:
            for group, lang, words, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != at:
                    yield from told()
                    at = group
                numbers, parts, counts = trees.get(lang) or trees.setdefault(lang, (_Numbers(lang), [], []))
                place = np.array([0, *map(numbers.__getitem__, words.split(b" "))], np.int64)
                rows = np.frombuffer(block, np.int32).reshape(-1, longest + 1)
                parts.append(place[rows[:, :longest]])
                counts.append(rows[:, longest].astype(np.int64))
                if len(parts) > 16 and sum(map(len, parts)) > 2_000_000:
                    leaves, n = _summed(np.concatenate(parts), np.concatenate(counts), len(numbers.words))
                    parts[:], counts[:] = [leaves], [n]
        yield from told()

    dealt = blocks.repartition(int(division.groups[-1]) + 1, "group").sortWithinPartitions("group")
    found = dealt.mapInArrow(run, "lang string, phrase binary, words int, f long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _part(words: Column, begin: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def _scored(nodes: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, score, k, l, r): each candidate with its lowest-scoring cut."""
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    candidates = nodes.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"first": _part(w, 1, F.col("k")), "rest": _part(w, F.col("k") + 1, F.col("words") - F.col("k"))})
    l, r = nodes.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), nodes.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = cut.join(l, ["lang", "first"]).join(r, ["lang", "rest"])
    # a is at most l and r, so a whole quotient is at most a million; the products have up to 38 digits.
    joined = joined.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a"), "under": exact("l") * exact("r")})
    best = joined.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "words", "a")).alias("best"))
    return best.select("lang", "phrase", "best.*")


def _surrounded(nodes: DataFrame) -> DataFrame:
    """(lang, phrase, around): the most occurrences that a longer candidate around a phrase has."""
    longer = nodes.filter("words > 2").withColumns({"w": F.split("phrase", " "), "size": F.explode(F.sequence(F.lit(2), F.col("words") - 1))})
    begin = F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1))
    longer = longer.select("lang", "w", "size", "f", begin.alias("begin")).select("lang", _part(F.col("w"), F.col("begin"), F.col("size")).alias("phrase"), "f")
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN, top: int | None = TOP, budget: int = GROUP_BUDGET, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to ``longest`` words, best first.

    A-Z are lower-cased, texts end in pieces at ``. , ; : ! ?`` and line ends, and words at blanks and tabs. ``a``
    counts the phrase's occurrences within pieces; ``l`` and ``r`` are those of both sides of its lowest-scoring
    cut; ``n`` is the number of the language's words. Null languages are ``und``, null texts empty; rows that
    repeat count again; empty tables give no rows, and other columns are not looked at.

    Words of fewer than ``least`` occurrences end a suffix, as no candidate can hold them; the filter that
    tells them has a fixed size, and where it errs it keeps a word. Nothing else is left out.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), utf8(text_column).alias("text"))
    words = stored(_words(rows).withColumn("h", F.xxhash64("lang", "word")), "words")
    frequent = _filter(words, least)
    division = _division(rows, words, frequent, longest, budget)
    nodes = stored(_nodes(_blocks(rows, division, frequent, longest), division, longest, least), "nodes")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = _scored(nodes)
    if longest > 2:
        scored = scored.join(_surrounded(nodes), ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < within * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank.cast("long"))
    if top is not None:
        ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    out = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    forget(words)
    forget(nodes)
    return out
