"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's word shingles. Sketches of parts merge into
the sketch of the whole, and from two sketches alone come resemblance, containment and the number of
distinct shingles. A text with fewer than k distinct shingles is held exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, tidied, utf8

K = 128
SHINGLE = 5
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as the longest text so far has bytes."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """48-bit hashes of all runs of ``width`` words (lower-case ASCII, white space as one blank); of the whole if shorter.

    Prefix sums of a polynomial in the bytes give every run's hash by one subtraction, whatever its length.
    """
    joined = np.frombuffer(b" ".join(text.lower().split()), np.uint8)
    if not len(joined):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _up.upto(len(joined))[: len(joined)], out=sums[1:])
    gaps = np.flatnonzero(joined == 32)
    begins, ends = np.r_[0, gaps + 1], np.r_[gaps, len(joined)]
    n = max(1, len(begins) - width + 1)
    begins, ends = begins[:n], ends[-n:]
    h = (sums[ends] - sums[begins]) * _down.upto(len(joined))[begins]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(16)


def sketch(text: bytes, k: int = K, width: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))[:k]


def merged(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the texts' shingles taken together."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all of both; two empty sketches resemble each other fully."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merged([a, b], k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2**48)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b, assume_unique=True).mean())
    r = resemblance(a, b, k)
    return min(1.0, r * (distinct_shingles(a, k) + distinct_shingles(b, k)) / ((1 + r) * distinct_shingles(a, k)))


def to_string(a: np.ndarray) -> str:
    """Eight base64 characters for each hash, smallest first."""
    return base64.b64encode(np.ascontiguousarray(a, ">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def sketched(documents: DataFrame, k: int = K, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, n_shingles): a sketch for each row; null and empty texts have the empty one."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("id"), utf8(text_column).alias("text"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sketch(t, k, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_string(a) for a in each], pa.string()), pa.array([distinct_shingles(a, k) for a in each], pa.float64())], names=["id", "fingerprint", "n_shingles"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string, n_shingles double")


def group_sketches(prints: DataFrame, group: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(group, fingerprint, n_shingles): sketches merged for each value of ``group``.

    Each partition merges its own rows first, so a group of any size sends at most one sketch from each
    partition; a second merge over 16 salts keeps a hot group's rows apart. Null is a group of its own.
    """
    kind = prints.schema[group].dataType.simpleString()

    @tidied
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(g, []).append(from_string(s or ""))
                if len(held[g]) >= 64:
                    held[g] = [merged(held[g], k)]
        if held:
            whole = {g: merged(each, k) for g, each in held.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(whole), batch.schema.field(0).type), pa.array([to_string(a) for a in whole.values()], pa.string()), pa.array([distinct_shingles(a, k) for a in whole.values()], pa.float64())],
                names=["group", "fingerprint", "n_shingles"],
            )

    schema = f"group {kind}, fingerprint string, n_shingles double"
    out = prints.select(F.col(group).alias("group"), F.col(fingerprint).alias("fingerprint")).mapInArrow(partial, schema)
    salted = out.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(16))).repartition("group", "salt").select("group", "fingerprint")
    return salted.mapInArrow(partial, schema).select("group", "fingerprint").repartition("group").mapInArrow(partial, schema)


def edited_neighbours(documents: DataFrame, k: int = K, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document.

    Documents stand in descending order of their ids (null ids last, equal ids by a hash of their text);
    after the last comes the first. A text's edited form has its last floor(n / 2) code points replaced by
    the first as many of the next text, or all of it if it is shorter. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_containment, n_shingles.

    Null texts count as empty. Texts cross one shuffle, dealt by ranges of ids; the first document of a
    range is also sent to the range before it. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        """0 for the highest ids; null ids come last."""
        missing = ids.isna()
        return pd.Series(np.where(missing, len(bounds) + 1, len(bounds) - np.searchsorted(bounds, ids.fillna(0).astype("int64"), "left"))).astype("int32")

    dealt = rows.withColumn("range", range_of("id"))
    # One row for each range (as many as the shuffle has partitions): its first document's id and the range before it.
    firsts = dealt.select("id", "range").groupBy("range").agg(F.max("id").alias("first"))
    last = F.max("range").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = firsts.select("first", F.coalesce(F.lag("range").over(Window.orderBy("range")), last).alias("before"))
    guests = rows.join(F.broadcast(edges), F.col("id").eqNullSafe(F.col("first"))).select("id", "text", F.col("before").alias("range"), F.lit(True).alias("guest"))
    both = dealt.withColumn("guest", F.lit(False)).union(guests)
    ordered = both.repartitionById(max(n, len(bounds) + 2), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_containment", "n_shingles"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next one
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for id_, raw, where, guest in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if guest and (held is None or held[0] != where):
                    continue
                text = raw.decode("utf-8", "replace")
                own = sketch(raw, k, width)
                if held is not None and held[0] == where:
                    for column, value in zip(out, _compared(held, text, own, k, width), strict=True):
                        column.append(value)
                held = None if guest else (where, id_, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_containment double, n_shingles double"
    return ordered.mapInArrow(run, schema)


def _compared(held: tuple, next_text: str, next_sketch: np.ndarray, k: int, width: int) -> tuple:
    _, id_, text, own = held
    half = len(text) // 2
    edited = (text[: len(text) - half] + next_text[:half]).encode()
    other = sketch(edited, k, width)
    return id_, len(text), hashlib.sha256(edited).hexdigest(), to_string(own), to_string(other), resemblance(own, other, k), resemblance(own, next_sketch, k), containment(own, other, k), distinct_shingles(own, k)
