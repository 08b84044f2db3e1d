"""Toxicity by a factorization machine over hashed terms.

Besides a weight each term has a short vector; a pair of terms in one text adds the product of their
vectors, so that an insult beside a group's name may count for more than both on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, letters_of, stored, tidied, utf8
from .sketches import _down, _up

TABLE_BITS = 18
#: Labelled rows of each class that the model is fitted on at most.
SAMPLE = 6000
#: Terms kept: the strongest by chi-square, if over CHI_SQUARE and in LEAST_ROWS sampled rows.
TERMS = 2048
CHI_SQUARE = 15.0
LEAST_ROWS = 3
#: Beside them those of the strongest pairs: of all pairs of the FREQUENT terms that stand in most rows (or are
#: missing in most), the first PAIRS by the chi-square of both together, if over PAIR_CHI_SQUARE and this many times either term's own.
FREQUENT = 2048
PAIRS = 256
PAIR_CHI_SQUARE = 40.0
PAIR_OVER_TERM = 2.0
RANK = 8
STEPS = 400
#: First bytes of a word that are terms too, so that endings do not hide a stem.
STEMS = (4, 6)


def terms(text: bytes) -> np.ndarray:
    """Distinct cells of the text's words and their stems: letters only, lower case, ascending."""
    joined = np.frombuffer(letters_of(text).encode(), np.uint8)
    if not len(joined):
        return np.empty(0, np.int64)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _up.upto(len(joined))[: len(joined)], out=sums[1:])
    gaps = np.flatnonzero(joined == 32)
    begins, ends = np.r_[0, gaps + 1], np.r_[gaps, len(joined)]
    down = _down.upto(len(joined))
    found = [(sums[ends] - sums[begins]) * down[begins]]
    for k, n in enumerate(STEMS):
        longer = ends - begins > n
        found.append((sums[begins[longer] + n] - sums[begins[longer]]) * down[begins[longer]] + np.uint64(k + 1))
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    cell: np.ndarray  # the terms' cells, ascending
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, text: bytes) -> float:
        at = np.searchsorted(self.cell, found := terms(text))
        hit = at[(at < len(self.cell)) & (self.cell[np.minimum(at, len(self.cell) - 1)] == found)] if len(self.cell) else at[:0]
        v = self.factor[hit]
        s = v.sum(axis=0)
        z = self.bias + self.weight[hit].sum() + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit the machine on at most ``sample`` labelled rows of each class, the first by a hash of their ids.

    Ids with several labels count as toxic if one of them says so; null labels and ids say nothing. With one
    class only or none the score is that class's share (half without any).
    """
    bounded_batches(documents.sparkSession)
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).cast("int").alias("y"))
    known = stored(known, "labels")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        p = 1.0 if sizes.get(1) else 0.0 if sizes.get(0) else 0.5
        return Model(np.empty(0, np.int64), float(np.log((p + 1e-6) / (1 - p + 1e-6))), np.empty(0), np.empty((0, RANK)))
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # at most twice ``sample`` rows of two numbers

    rows = documents.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).join(chosen, "id").select("y", "text")

    @tidied
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [terms(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["y", "cells"])

    features = stored(rows.mapInArrow(featured, "y int, cells binary"), "toxic-terms")

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << TABLE_BITS), np.int64)
        for batch in batches:
            for y, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y, np.frombuffer(cells, np.int32)] += 1
        for y in (0, 1):
            at = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[y, at])], names=["y", "cell", "n"])

    seen = features.mapInArrow(counted, "y int, cell int, n long").groupBy("cell").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean")).filter(F.col("toxic") + F.col("clean") >= LEAST_ROWS).toArrow()
    rows_of = {r["y"]: r["count"] for r in features.groupBy("y").count().collect()}
    n_toxic, n_clean = rows_of.get(1, 0), rows_of.get(0, 0)
    cells, toxic, clean = (seen.column(c).to_numpy() for c in ("cell", "toxic", "clean"))
    alone, many = _strongest(cells, toxic, clean, n_toxic, n_clean), _frequent(cells, toxic + clean, n_toxic + n_clean)
    looked = np.union1d(alone, many)

    @tidied
    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(np.isin(looked, np.frombuffer(c, np.int32), assume_unique=True)).astype(np.int32).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["y", "at"])

    data = features.mapInArrow(narrowed, "y int, at binary").toArrow().combine_chunks()
    y, at = data.column("y").to_numpy(), [np.frombuffer(a, np.int32) for a in data.column("at").to_pylist()]
    cell = np.union1d(alone, many[_of_pairs(_columns(at, looked, many), y)])
    x = np.concatenate([*_columns(at, looked, cell)]) if len(y) else np.zeros((0, len(cell)), np.float32)
    order = np.lexsort((x @ np.arange(1, len(cell) + 1), y))  # the same fit whatever the order of rows
    x, y = x[order], y[order]
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    return Model(cell, *_fit(x, y.astype(np.float32), (weight / weight.sum()).astype(np.float32)))


def _chi_square(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of what stands in so many toxic and clean rows."""
    a, b = toxic.astype(float), clean.astype(float)
    n, both = n_toxic + n_clean, a + b
    return n * (a * (n_clean - b) - b * (n_toxic - a)) ** 2 / np.maximum(1.0, float(n_toxic) * n_clean * both * (n - both))


def _strongest(cell: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    chi = _chi_square(toxic, clean, n_toxic, n_clean)
    good = np.flatnonzero(chi > CHI_SQUARE)
    good = good[np.lexsort((cell[good], -chi[good]))][:TERMS]
    return np.sort(cell[good]).astype(np.int64)


def _frequent(cell: np.ndarray, rows: np.ndarray, every: int) -> np.ndarray:
    """The terms that part the rows most evenly."""
    smaller = np.minimum(rows, every - rows)
    return np.sort(cell[np.lexsort((cell, -smaller))][:FREQUENT]).astype(np.int64)


def _columns(at: list[np.ndarray], looked: np.ndarray, wanted: np.ndarray, step: int = 1000) -> Iterator[np.ndarray]:
    """The rows' terms as zeros and ones of the wanted cells, some rows at a time. ``at``: places in ``looked``."""
    for begin in range(0, len(at), step):
        x = np.zeros((min(step, len(at) - begin), len(looked)), np.float32)
        for k, a in enumerate(at[begin : begin + step]):
            x[k, a] = 1
        yield x[:, np.searchsorted(looked, wanted)]


def _of_pairs(x: Iterator[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Columns of the pairs that tell much more together than either alone."""
    together, begin = {0: 0, 1: 0}, 0
    for part in x:
        own = y[begin : begin + len(part)]
        for label in (0, 1):
            together[label] = together[label] + part[own == label].T @ part[own == label]
        begin += len(part)
    if not begin or not np.shape(together[0])[0]:
        return np.empty(0, np.int64)
    n_toxic, n_clean = int((y == 1).sum()), int((y == 0).sum())
    each = _chi_square(np.diag(together[1]), np.diag(together[0]), n_toxic, n_clean)
    a, b = np.triu_indices(len(each), 1)
    chi = _chi_square(together[1][a, b], together[0][a, b], n_toxic, n_clean)
    good = np.flatnonzero((chi > PAIR_CHI_SQUARE) & (chi > PAIR_OVER_TERM * np.maximum(each[a], each[b])))
    good = good[np.argsort(-chi[good], kind="stable")][:PAIRS]
    return np.unique(np.r_[a[good], b[good]])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss with ridge terms, by Adam on the whole (bounded) sample."""
    draw = np.random.default_rng(1)
    parts = [np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), (0.01 * draw.standard_normal((x.shape[1], RANK))).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        bias, w, v = parts
        s = x @ v
        z = bias + x @ w + 0.5 * ((s * s).sum(axis=1) - x @ (v * v).sum(axis=1))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gx = x.T @ g
        grads = [np.array([g.sum()], np.float32), gx + 2e-5 * w, x.T @ (g[:, None] * s) - gx[:, None] * v + 1e-4 * v]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            parts[k] = parts[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return float(parts[0][0]), parts[1], parts[2]


def scored(documents: DataFrame, model: Model, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted): each row's score from its whole text alone; null and empty texts get the bias's score."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("id"), utf8(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([shared.value.score(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {kind}, score double, predicted int")
