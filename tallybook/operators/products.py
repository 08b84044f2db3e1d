"""Sums over shared terms of all pairs of two tables, block by block: no pair is shuffled, and no term gathers rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, stored

#: Terms of asked rows that a task holds, and those of other rows from which they are dealt in more parts, up to MANY parts unless a part had over LONG.
BLOCK = 1 << 22
PART = 1 << 20
MANY = 32
LONG = 1 << 25
#: Pairs in a batch that leaves a task.
PAIRS = 1 << 17


class _Asked:
    """A block of asked rows by their terms."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        terms = table["terms"].combine_chunks()
        coded = terms.flatten().dictionary_encode()
        self.keys, self.vocabulary, codes = table["i"].combine_chunks(), coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        rows = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())[order]
        cuts = np.cumsum(np.bincount(codes, minlength=len(self.vocabulary)))[:-1]
        self.rows = np.split(rows, cuts)
        weights = table["weights"].combine_chunks().flatten().to_numpy()[order]
        self.weights, self.plain = np.split(weights, cuts), bool((weights == 1).all())

    def sums(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """For each row the sums with all asked rows."""
        terms = batch.column("terms")
        coded = terms.flatten().dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.vocabulary).fill_null(-1).to_numpy()
        codes, weights = known[coded.indices.to_numpy()], batch.column("weights").flatten().to_numpy()
        ends = np.cumsum(pc.list_value_length(terms).to_numpy())
        plain = self.plain and bool((weights == 1).all())
        start, n = 0, len(self.keys)
        for end in ends.tolist():
            mine = codes[start:end]
            met = [(c, w) for c, w in zip(mine.tolist(), weights[start:end].tolist()) if c >= 0]
            start = end
            if not met:
                yield np.zeros(n)
            elif plain:
                yield np.bincount(np.concatenate([self.rows[c] for c, _ in met]), minlength=n)
            else:
                yield np.bincount(np.concatenate([self.rows[c] for c, _ in met]), np.concatenate([self.weights[c] * w for c, w in met]), n)


class _Best:
    """The ``first`` largest sums of each asked row so far; of equal ones those that came first."""

    def __init__(self, n: int, first: int) -> None:
        self.first, self.least, self.came, self.rows = first, np.full(n, -np.inf), 0, [np.zeros(0, np.int64)] * 3
        self.new: list[tuple[np.ndarray, ...]] = []

    def add(self, i: np.ndarray, sums: np.ndarray, j: int) -> None:
        better = sums > self.least[i]
        if better.any():
            self.new.append((i[better], sums[better], np.full(int(better.sum()), j)))
            self.came += len(self.new[-1][0])
            if self.came > max(PAIRS, 4 * self.first * len(self.least)):
                self.prune()

    def prune(self) -> None:
        i, sums, j = (np.concatenate([old, *x]) for old, x in zip(self.rows, zip(*self.new, strict=True) if self.new else ((), (), ()), strict=True))
        order = np.lexsort((j, -sums, i))
        i, sums, j = i[order], sums[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < self.first
        self.rows, self.new, self.came = [i[kept], sums[kept], j[kept]], [], 0
        full = place == self.first - 1
        self.least[i[full]] = sums[full]


def shared_sums(a: DataFrame, b: DataFrame, least: float, first: int | None = None) -> DataFrame:
    """(i, j, total): all pairs of a row of ``a`` (i, terms, weights) and one of ``b`` (j, terms, weights) whose sum over
    shared terms, of the weights' products, is ``least`` (over 0) or more. A row has a term once and no null
    ones; without weights each weighs 1.

    ``a`` is dealt in blocks that fit a task and ``b`` in parts, each block to all parts and each part to all
    blocks, and a task holds its block while the part passes by. So what is shuffled are rows and not pairs,
    and a task's memory does not depend on the input. Keys may be structs. With ``first``, of each i and part only
    the largest sums, and of equal ones the least j, come: rank them again.
    """
    if least <= 0:
        raise ValueError("least must be over 0")
    ones = lambda t: t if "weights" in t.columns else t.withColumn("weights", F.transform("terms", lambda _: F.lit(1.0)))
    a, b = (stored(ones(t).filter(F.size("terms") > 0).select(k, "terms", "weights", F.size("terms").alias("n")), name) for t, k, name in ((a, "i", "asked"), (b, "j", "others")))
    n_a, n_b = (t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (a, b))
    blocks, parts = 1 + n_a // BLOCK, 1 + min(n_b // PART, max(MANY, n_b // LONG))
    own = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t, k: F.lit(None).cast(t.schema[k].dataType).alias(k)
    asked = a.select(own("i", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), "i", none(b, "j"), "terms", "weights")
    others = b.select(every(blocks).alias("block"), own("j", parts).alias("part"), F.lit(1).alias("side"), none(a, "i"), "j", "terms", "weights")
    cells = asked.union(others).withColumn("cell", (F.col("block") * parts + F.col("part")).cast("int")).drop("block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, held, best = None, [], None, None
        out_i, out_j, out_s, ready = [], [], [], 0

        def leave() -> Iterator[pa.RecordBatch]:
            nonlocal out_i, out_j, out_s, ready
            if ready:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out_i), pa.concat_arrays(out_j), pa.array(np.concatenate(out_s).astype(np.float64))], names=["i", "j", "total"])
            out_i, out_j, out_s, ready = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal best
            if best is not None:
                best.prune()
                i, s, j = best.rows
                for k in range(0, len(i), PAIRS):
                    yield pa.RecordBatch.from_arrays([held.keys.take(pa.array(i[k : k + PAIRS])), pa.concat_arrays(seen).take(pa.array(j[k : k + PAIRS])), pa.array(s[k : k + PAIRS].astype(np.float64))], names=["i", "j", "total"])
            best = None

        seen: list[pa.Array] = []
        count = 0
        for batch in batches:
            cells_of, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(cells_of) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if cells_of[lo] != cell:
                    yield from close()
                    cell, waiting, held, seen, count = cells_of[lo], [], None, [], 0
                piece = batch.slice(lo, hi - lo)
                if sides[lo] == 0:
                    waiting.append(piece)
                    continue
                if held is None:
                    if not waiting:
                        continue
                    held, waiting = _Asked(waiting), []
                    best = _Best(len(held.keys), first) if first else None
                keys = piece.column("j")
                if first:
                    seen.append(keys)
                for k, sums in enumerate(held.sums(piece)):
                    i = np.flatnonzero(sums >= least)
                    if not len(i):
                        continue
                    if first:
                        best.add(i, sums[i], count + k)
                        continue
                    out_i.append(held.keys.take(pa.array(i)))
                    out_j.append(pc.take(keys, pa.array(np.full(len(i), k))))
                    out_s.append(sums[i])
                    ready += len(i)
                    if ready >= PAIRS:
                        yield from leave()
                count += len(keys)
        yield from close()
        yield from leave()

    kind = lambda t, k: t.schema[k].dataType.simpleString()
    return cells.repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "side", "j").mapInArrow(run, f"i {kind(a, 'i')}, j {kind(b, 'j')}, total double")
