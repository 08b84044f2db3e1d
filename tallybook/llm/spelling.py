"""Spelling variants from a dictionary of trie-node pairs.

All words stand in a trie, and reversed in another; nodes are numbered. A word without its i-th letter is the
pair (node of the letters before, reversed node of the letters after), and a word as it is, parted anywhere, is
a pair too. Two words one letter apart share such a pair, and words that share one are one letter apart: the
pairs are whole numbers that stand for exact texts, so nothing is verified afterwards and nothing is missed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidied, utf8

LEAST_LETTERS = 6
LEAST_OCCURRENCES = 5
#: A word's form has at least so many times its occurrences.
TIMES = 5
#: One in so many runs, by hash, loses a letter.
DROPPED_IN = 199
#: A task hands its counts on when it holds so many words.
TASK_WORDS = 300_000

# A-Z, a-z and U+00C0 to U+00FF in UTF-8; C3 always begins a character.
_RUN = re.compile(rb"(?:[A-Za-z]+|(?:\xc3[\x80-\xbf])+)+")


def altered(run: bytes, prefix_crc: int, dropped_in: int = DROPPED_IN) -> bytes:
    """The run in lower case, without the letter that its hash picks if ``dropped_in`` divides the hash."""
    h = zlib.crc32(run, prefix_crc)
    if h % dropped_in:
        return run
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def vocabulary(documents: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_OCCURRENCES, dropped_in: int = DROPPED_IN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the words of ``least_letters`` code points and ``least`` occurrences or more.

    Words are whole runs of Latin letters, A-Z lower-cased. One in ``dropped_in`` of the (document, run) pairs loses
    a letter, which plants misspellings of known place. Null texts have no words; the hash of a null id begins
    with nothing; rows that repeat count again. Tasks count before anything is shuffled.
    """
    bounded_batches(documents.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            kept = [(w, n) for w, n in counts.items() if len(w) - w.count(b"\xc3") >= least_letters]
            for k in range(0, len(kept), 20_000):
                words, n = zip(*kept[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                crc = zlib.crc32(b"" if key is None else str(key).encode())
                crc = zlib.crc32(b":", crc)
                for word, n in Counter(_RUN.findall(text.lower())).items():
                    # Shorter runs cannot become words.
                    if len(word) >= least_letters:
                        counts[altered(word, crc, dropped_in)] += n
            if len(counts) >= TASK_WORDS:
                yield from told()
        yield from told()

    rows = documents.select(F.col(id_column).alias("id"), utf8(text_column).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _common(a: str, b: str) -> int:
    """Letters that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        half = (low + n) // 2
        low, n = (half, n) if a[:half] == b[:half] else (low, half)
    return low


def numbered(words: DataFrame, letters: Column) -> DataFrame:
    """(word, n, place, nodes, ends): each word with the numbers of its trie's nodes; stored.

    ``nodes`` has a number for each prefix of ``letters``, from the empty one on. Words lie in order, dealt to
    ranges. A node gets its number where its prefix first comes in a range: a word takes over the nodes of what
    it shares with the word before it. The driver gets the first and last word of each range, and the nodes at
    the head of a range that the range before it has numbered already are renamed, so that a prefix has one
    number throughout. ``place`` numbers the words in the order of ``letters`` (by code points); ``ends`` says
    whether a letter differs from the next.
    """
    names = ["word", "n", "place", "nodes", "ends", "first", "last"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.string(), pa.string()]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = place = fresh = TaskContext.get().partitionId() << 36
        first, before, nodes, head = None, "", [], []
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for word, n, spelled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = _common(before, spelled) + 1 if nodes else 0
                new = len(spelled) + 1 - shared
                nodes = nodes[:shared] + list(range(fresh, fresh + new))
                fresh += new
                if first is None:
                    first, head = spelled, nodes
                before = spelled
                rows.append((word, n, place, nodes, [*map(ne, spelled, spelled[1:]), True], None, None))
                place += 1
                size += len(nodes)
                if size > 100_000:
                    yield told(rows)
                    rows, size = [], 0
        if first is not None:
            rows.append((None, len(head), base, nodes, None, first, before))
            yield told(rows)

    ranged = words.select("word", "n", letters.alias("letters")).repartitionByRange("letters").sortWithinPartitions("letters")
    found = stored(ranged.mapInArrow(run, "word string, n long, place long, nodes array<long>, ends array<boolean>, first string, last string"), "trie")
    same: dict[int, int] = {}
    before, above = None, []
    for edge in sorted(found.filter("word is null").select("place", "nodes", "first", "last").collect(), key=lambda e: e["first"]):
        for k in range(_common(before, edge["first"]) + 1 if before is not None else 0):
            same[edge["place"] + k] = above[k]
        above = [same.get(node, node) for node in edge["nodes"]]
        before = edge["last"]
    old = np.array(sorted(same), np.int64)
    fresh = np.array([same[k] for k in old.tolist()], np.int64)

    @tidied
    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            nodes = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(old, nodes), max(0, len(old) - 1))
            if len(old) and len(nodes):
                nodes = np.where(old[at] == nodes, fresh[at], nodes)
            offsets = lists.offsets.to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(nodes, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, batch.column(4)], names=names[:5])

    out = stored(found.filter("word is not null").select(*names[:5]).mapInArrow(renamed, "word string, n long, place long, nodes array<long>, ends array<boolean>"), "trie")
    forget(found)
    return out


def _pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(p, s, id, n, role): the pairs of nodes of each word: 0, the word parted; 1 or 2, the word without a letter.

    A letter within a run of equal ones can go in several places with one result: only the last has role 2.
    """
    both = forward.select("word", F.col("place").alias("id"), "n", F.col("nodes").alias("p"), "ends").join(backward.select("word", F.reverse("nodes").alias("s")), "word")
    size = F.size("ends")
    parted = F.transform(F.arrays_zip("p", "s"), lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s"), F.lit(0).alias("role")))
    skipped = F.arrays_zip(F.slice("p", F.lit(1), size).alias("p"), F.slice("s", F.lit(2), size).alias("s"), F.col("ends").alias("e"))
    skipped = F.transform(skipped, lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s"), F.when(x["e"], 2).otherwise(1).alias("role")))
    return both.select("id", "n", F.explode(F.concat(parted, skipped)).alias("pair")).select("pair.p", "pair.s", "id", "n", "pair.role")


def near(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one letter from each word that has such, and the most frequent of them.

    Words without one letter that share a pair differ there alone: they are as many as letters can stand in one
    place, so a group is bounded by the alphabet. A word parted at the pair is the one that lacks the letter.
    Every two words meet in one group of their kind exactly, so counts add up, and the best of a group is
    one of its first two: no pairs of words are made. ``best`` is (n, back), ``back`` being minus the id.
    """
    met = _pairs(forward, backward).groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("back"), "role")).alias("g")).filter(F.size("g") > 1)
    ranked = met.select("g", F.sort_array(F.filter("g", lambda m: m["role"] > 0), asc=False).alias("skipped"), F.get(F.filter("g", lambda m: m["role"] == 0), F.lit(0)).alias("parted"))
    ranked = ranked.withColumn("longer", F.filter("skipped", lambda m: m["role"] == 2))
    told = ranked.select("skipped", "parted", "longer", F.explode("g").alias("m"))
    plain = lambda c: F.when(c.isNotNull(), F.struct(c["n"].alias("n"), c["back"].alias("back")))
    first, second = F.get("skipped", F.lit(0)), F.get("skipped", F.lit(1))
    other = F.when(first["back"] == F.col("m.back"), plain(second)).otherwise(plain(first))
    shorter = F.when(F.col("m.role") == 2, plain(F.col("parted")))
    lone = F.col("m.role") == 0
    told = told.select(
        (-F.col("m.back")).alias("id"),
        F.when(lone, F.size("longer")).otherwise(F.size("skipped") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("n_near"),
        F.when(lone, plain(F.get("longer", F.lit(0)))).otherwise(F.greatest(other, shorter)).alias("best"),
    )
    return told.filter("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of each chain of ``forms`` (id, form), by doubling; counts grow along a chain, so it is short."""
    tree = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        up = tree.select(F.col("id").alias("root"), F.col("root").alias("top"))
        step = stored(tree.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        forget(tree)
        tree, moved = step, step.filter("moved").limit(1).count()
        if not moved:
            return tree


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word string, n long), whose words differ.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest ``n`` (ties: the smallest in code-point order) if that is ``times`` its own or more; its root is
    where forms lead, the word itself without a form. Null words are left out, null counts are 0; words of any
    length, the empty one too, are compared; other columns are not looked at; an empty table gives no rows.
    """
    if times < 2:
        raise ValueError("counts must grow along a chain: times is 2 at least")
    bounded_batches(words.sparkSession)
    words = stored(words.select(F.col("word").cast("string").alias("word"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n")).filter("word is not null"), "vocabulary")
    forward, backward = numbered(words, F.col("word")), numbered(words, F.reverse("word"))
    close = stored(near(forward, backward), "near")
    forget(backward)
    plain = forward.select(F.col("place").alias("id"), "word", "n")
    chosen = plain.join(close, "id", "left").withColumn("form_id", F.when((F.col("best.n") > 0) & (F.col("best.n") >= times * F.col("n")), -F.col("best.back")))
    roots = _roots(chosen.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = chosen.join(plain.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id", "left")
    named = named.join(roots.select("id", F.col("root").alias("root_id")), "id", "left").join(plain.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id", "left")
    out = stored(named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "variants")
    for table in (words, forward, close, roots):
        forget(table)
    return out
