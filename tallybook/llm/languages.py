"""Language identification as a mixture of languages.

A document's byte 4-grams are draws from a mixture of the languages' n-gram distributions and of noise, in
which all grams are alike. Expectation-maximisation finds the proportions; which languages are in the
mixture at all is chosen by penalised likelihood. The main language is the prediction and its proportion
the score, so what no language explains lowers it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, letters_of, tidied, utf8

#: Cells of the hashed n-gram table.
TABLE_BITS = 16
#: Documents of a language that its distribution is learned from, about; a bounded sample by hash of the id.
SAMPLE = 2000
SMOOTHING = 0.3
#: Expectation-maximisation ends when no proportion moves by more, or after so many steps.
SETTLED = 1e-4
STEPS = 300
#: What a further language must gain in log likelihood for the logarithm of the number of grams.
PENALTY = 6.0
UNKNOWN = "und"


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the text's 4-grams over letters and single blanks, lower case, and their counts; none without a letter."""
    letters = letters_of(text)
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.frombuffer(f"  {letters}  ".encode(), np.uint8).astype(np.uint32)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    cells = np.sort(((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return cells[first].astype(np.int64), np.diff(np.r_[first, len(cells)])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    likelihood: np.ndarray  # (cells, languages), float32

    @functools.cached_property
    def with_noise(self) -> np.ndarray:
        """A last column for noise."""
        return np.c_[self.likelihood, np.full(1 << TABLE_BITS, 1 / (1 << TABLE_BITS), np.float32)]


def train(documents: DataFrame, lang_column: str = "lang", text_column: str = "text", id_column: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn each language's n-gram distribution from ``documents``; rows without a language say nothing.

    About ``sample`` documents of each language are read, chosen by a hash of their ids; only counts come
    to the driver, at most languages x cells of them.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.filter(F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_column), F.lit("language")), F.lit(1 << 30)).alias("draw"), F.col(text_column).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.empty((1 << TABLE_BITS, 0), np.float32))
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, sample / n))).otherwise(limit)
    chosen = rows.filter(F.col("draw") < limit).select("lang", utf8("text").alias("text"))

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells, n = grams(text)
                held.setdefault(lang, np.zeros(1 << TABLE_BITS, np.int64))[cells] += n
        for lang, counts in held.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], names=["lang", "cell", "n"])

    counted = chosen.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[counted.column("cell").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    counts += SMOOTHING
    return Model(languages, (counts / counts.sum(axis=0)).astype(np.float32))


def mixture(likelihood: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns by expectation-maximisation, and the log likelihood."""
    k = likelihood.shape[1]
    share, total = np.full(k, 1 / k, np.float32), n.sum()
    for _ in range(STEPS):
        old, share = share, share * (likelihood.T @ (n / (likelihood @ share))) / total
        if np.abs(share - old).max() < SETTLED:
            break
    return share, float(n @ np.log(likelihood @ share))


def infer(model: Model, text: bytes) -> tuple[str, float, dict[str, float]]:
    """(main language, its proportion, proportions of the chosen set); ``und`` and 0 without a letter or a language.

    Noise is always in the mixture. Sets are tried in the order of the languages' proportions in the
    mixture of all, up to those that have half a gram; a further language is not tried once even the fit of
    all languages could not pay its penalty.
    """
    cells, n = grams(text)
    if not len(cells) or not model.languages:
        return UNKNOWN, 0.0, {}
    n = n.astype(np.float32)
    likelihood = model.with_noise[cells]
    share, most = mixture(likelihood, n)
    order = np.argsort(-share[:-1], kind="stable")
    price = PENALTY * np.log(1 + n.sum())
    best = None
    for size in range(1, max(1, int((share[:-1] * n.sum() >= 0.5).sum())) + 1):
        if best is not None and best[0] >= most - price * size:
            break
        chosen = order[:size]
        own, fit = mixture(likelihood[:, [*chosen, -1]], n)
        if best is None or fit - price * size > best[0]:
            best = (fit - price * size, chosen, own)
    _, chosen, own = best
    top = int(np.argmax(own[:-1]))
    return model.languages[chosen[top]], float(min(1.0, own[top])), {model.languages[c]: float(p) for c, p in zip(chosen, own, strict=False)}


def identified(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, mixture): the prediction for each row from its whole text alone.

    ``mixture`` maps the chosen languages to their proportions; what is left to one is noise. Null texts and texts without a letter are
    ``und`` with score 0 and an empty map; rows are kept as they are, repeated ones included.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("id"), utf8(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [infer(shared.value, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e[0] for e in each], pa.string()), pa.array([e[1] for e in each], pa.float64()), pa.array([list(e[2].items()) for e in each], pa.map_(pa.string(), pa.float64()))],
                names=["id", "lang_pred", "score", "mixture"],
            )

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, mixture map<string,double>")


def accepted(documents: DataFrame, model: Model, least: float = 0.0, text_column: str = "text") -> DataFrame:
    """The documents, all columns, whose language is known and has more than ``least`` of the mixture."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def proportion(texts: pd.Series) -> pd.Series:
        return pd.Series([infer(shared.value, t)[1] for t in texts], dtype="float64")

    return documents.filter(proportion(utf8(text_column)) > least)


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == part
