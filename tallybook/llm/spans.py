"""Substring deduplication by sliding spans of pieces of sentences.

Every run of consecutive pieces is hashed and met with all others of the corpus; a piece covered by any
repeated run that is not the run's first occurrence is removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidied, utf8, whole
from .sketches import _down, _up

#: A run is the shortest stretch from its first piece on that has so many pieces and so many words.
RUN_SENTENCES = 1
RUN_WORDS = 20
#: Of so many gaps between words in a row at least one is a cut. Two texts that share RUN_WORDS + 2 * CUT_WITHIN words have a run in common.
CUT_WITHIN = 12

_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_STOP = np.isin(np.arange(256), list(b".!?"))
_QUOTE = np.isin(np.arange(256), list(b"\"')]"))


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(begin, end, words): the pieces of sentences in order, their byte ranges covering the whole text.

    A piece ends with a sentence (after . ! ? before white space), at a blank line, and at the least hash of
    every CUT_WITHIN neighbouring gaps. A gap's hash is that of its two words, so where a passage is cut
    depends, but for its first and last words, on itself alone, wherever it stands and its lines end.
    """
    words = text.lower().split()
    if not words:
        return []
    data = np.frombuffer(text, np.uint8)
    blank = np.r_[True, _SPACE[data], True]
    begins, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    cut = _STOP[data[ends - 1]]
    for k in np.flatnonzero(_QUOTE[data[ends - 1]]):
        cut[k] = words[k].rstrip(b"\"')]").endswith((b".", b"!", b"?"))
    cut = cut[:-1]
    lines = np.flatnonzero(data == 10)
    cut |= np.diff(np.searchsorted(lines, begins)) > 1
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    gaps = each[:-1] * np.uint64(0x9E3779B97F4A7C15) + each[1:]
    gaps = (gaps ^ (gaps >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    gaps ^= gaps >> np.uint64(27)
    if len(gaps) >= CUT_WITHIN:
        # The last of equal hashes, by looking from the end.
        least = np.lib.stride_tricks.sliding_window_view(gaps[::-1], CUT_WITHIN).argmin(axis=1)
        cut[len(gaps) - 1 - (np.arange(len(least)) + least)] = True
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), len(words)]
    places = [0, *begins[edges[1:-1]].tolist(), len(text)]
    return [(places[k], places[k + 1], words[edges[k] : edges[k + 1]]) for k in range(len(edges) - 1)]


def runs(words: list[list[bytes]], least_sentences: int = RUN_SENTENCES, least_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of each run of pieces, by their numbers; a hash is a row of two 64-bit words.

    Each word is a polynomial in half of the pieces' 128-bit hashes, taken as a difference of prefix sums.
    """
    n = len(words)
    total = np.zeros(n + 1, np.int64)
    np.cumsum([len(w) for w in words], out=total[1:])
    first = np.arange(n)
    last = np.maximum(first + least_sentences, np.searchsorted(total, total[:-1] + least_words)) - 1
    first = first[last < n]
    last = last[: len(first)]
    if len(last) and last[-1] < n - 1:
        # To the end, so that a whole copy leaves nothing.
        first, last = np.r_[first, first[-1]], np.r_[last, n - 1]
    each = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), ">u8").astype(np.uint64).reshape(-1, 2)
    sums = np.zeros((n + 1, 2), np.uint64)
    np.cumsum(each * _up.upto(n)[:n, None], axis=0, out=sums[1:])
    h = (sums[last + 1] - sums[first]) * _down.upto(max(1, n))[first, None] + (last - first).astype(np.uint64)[:, None]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return first, last, h ^ (h >> np.uint64(31))


def _row_key(documents: DataFrame, id_column: str, text_column: str) -> Column:
    """What tells rows with equal ids apart: the hash of their text where there are such rows, else zero."""
    again = documents.groupBy(id_column).count().filter("count > 1").limit(1).count()
    return F.xxhash64(text_column) if again else F.lit(0).cast("long")


def spans(documents: DataFrame, row_key: Column, id_column: str = "doc_id", text_column: str = "text", least_sentences: int = RUN_SENTENCES, least_words: int = RUN_WORDS) -> DataFrame:
    """(h1 long, h2 int, id, row, place): every run of every document; place is its first piece's number x 2**32 + its last's.

    Each document has one more row, without a hash, whose place is its number of pieces.
    """
    bounded_batches(documents.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[w for _, _, w in sentences(text)] for text in batch.column(2).to_pylist()]
            if not parts:
                continue
            found = [runs(p, least_sentences, least_words) for p in parts]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f, _, _ in found]))
            hashes = np.concatenate([h for _, _, h in found])
            places = np.concatenate([(f << 32) + l for f, l, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].view(np.int64)), pa.array((hashes[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places)], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int32()), batch.column(0), batch.column(1), pa.array([len(p) for p in parts], pa.int64())], names=names)

    names = ["h1", "h2", "id", "row", "place"]
    return documents.select(F.col(id_column).cast("long").alias("id"), row_key.alias("row"), utf8(text_column).alias("text")).mapInArrow(run, "h1 long, h2 int, id long, row long, place long")


def repeats(every: DataFrame) -> DataFrame:
    """(id, row, place): the runs of ``spans`` that occurred before, in the order of ids, then of row keys and places.

    First only half the hashes are counted, with map-side sums; the places of those met once are never
    shuffled with an origin. A hash of many copies sends a row from each task to the minimum, and adaptive
    execution may split it in the joins. Hashes have 96 bits together, so that no two runs share one by chance.
    """
    hashed = every.filter("h1 is not null")
    often = hashed.groupBy("h1").count().filter("count > 1").select("h1")
    met = stored(hashed.join(often, "h1", "left_semi"), "met")
    origin = met.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "place")).alias("origin"))
    again = stored(met.join(origin, ["h1", "h2"]).filter(~F.struct("id", "row", "place").eqNullSafe(F.col("origin"))).select("id", "row", "place"), "again")
    forget(met)
    return again


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_sentences: int = RUN_SENTENCES, least_words: int = RUN_WORDS) -> DataFrame:
    """The documents with the text freed of repeated passages, and n_sentences, n_removed, removed.

    ``removed`` lists (begin, end) byte ranges of the original text. The first occurrence of a passage, by
    smallest id, stays. Runs of under ``least_words`` words never count, so common short lines stay.
    ``n_sentences`` and ``n_removed`` count pieces (see ``sentences``); up to a piece at each end of a
    passage may stay.

    Null texts have no sentence and stay null, empty ones stay empty; rows that repeat id and text are
    one document and keep or lose the same sentences; null ids come before all others. All input columns
    are returned; any of the three result columns' names in the input are replaced.
    """
    documents = documents.drop("n_sentences", "n_removed", "removed")
    row_key = _row_key(documents, id_column, text_column)
    # Texts are taken apart once; both passes over the runs read the table.
    every = stored(spans(documents, row_key, id_column, text_column, least_sentences, least_words), "runs")
    none = F.lit(None).cast("long")
    again = repeats(every)
    marks = again.select("id", "row", F.col("place").alias("mark"), none.alias("n"))
    counts = every.filter("h1 is null").select("id", "row", none.alias("mark"), F.col("place").alias("n"))
    by_document = stored(marks.union(counts).groupBy("id", "row").agg(F.collect_set("mark").alias("marks"), F.max("n").alias("n")), "marks")
    forget(every)
    forget(again)
    keyed = documents.select(whole(documents), F.col(id_column).cast("long").alias("own_id"), row_key.alias("own_row"))
    joined = keyed.join(by_document, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_row").eqNullSafe(F.col("row")), "left")

    @F.pandas_udf("text binary, n_removed long, removed array<struct<begin:long,end:long>>")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, m) for t, m in zip(texts, marks, strict=True)], columns=["text", "n_removed", "removed"])

    own = F.col("document")
    done = joined.withColumn("cut", cut(utf8(own[text_column]), F.col("marks")))
    kept = [F.when(own[c].isNotNull(), F.col("cut.text").cast("string")).alias(c) if c == text_column else own[c].alias(c) for c in documents.columns]
    return done.select(*kept, F.col("n").alias("n_sentences"), "cut.n_removed", "cut.removed")


def _cut(text: bytes, marks: np.ndarray) -> tuple[bytes, int, list[dict[str, int]]]:
    if not len(marks):
        return text, 0, []
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for code in marks:
        gone[code >> 32] += 1
        gone[(code & 0xFFFFFFFF) + 1] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    removed: list[dict[str, int]] = []
    for k in np.flatnonzero(covered):
        begin, end, _ = parts[k]
        if removed and removed[-1]["end"] == begin:
            removed[-1]["end"] = end
        else:
            removed.append({"begin": begin, "end": end})
    kept, at = [], 0
    for piece in removed:
        kept.append(text[at : piece["begin"]])
        at = piece["end"]
    return b"".join([*kept, text[at:]]), int(covered.sum()), removed


def rid_of_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The documents, same columns, without repeated passages and with their new lengths; those left without a word go."""
    done = without_repeats(documents, id_column, text_column)
    kept = done.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_sentences")))
    length = F.when(F.col("n_removed") > 0, F.char_length(text_column)).otherwise(F.col(length_column)).cast(documents.schema[length_column].dataType)
    return kept.select(*(length.alias(c) if c == length_column else F.col(c) for c in documents.columns))
