"""Similarities. What SQL functions cannot express runs on Arrow batches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import confused_places, loose_ref, scan_key

ColumnOrName = Column | str


def ref_verdict(a: Column, b: Column) -> Column:
    """missing, same, zeros (differ in zeros only), size (same stem, other last number) or open to fuzzy matching."""
    x, y = loose_ref(a), loose_ref(b)
    bare = lambda s: F.replace(s, F.lit("0"), F.lit(""))
    stem = lambda s: F.regexp_replace(s, "[0-9]+$", "")
    empty = lambda s: F.coalesce(s, F.lit("")) == ""
    sizes = x.rlike("[0-9]$") & y.rlike("[0-9]$") & (stem(x) == stem(y))
    return F.when(empty(a) | empty(b), "missing").when(x == y, "same").when(bare(x) == bare(y), "zeros").when(sizes, "size").otherwise("open")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit for each character of ``a``, one step for each of ``b``."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 x twice the common subsequence over both lengths; 100 for two empty texts."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_length(a, b) / total


def sorted_words(s: str) -> str:
    return " ".join(sorted(s.lower().split()))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(indel_ratio(sorted_words(x), sorted_words(y))) for x, y in zip(a, b, strict=True)], dtype="Int32")


def token_sort_ratio(a: str, b: str) -> Column:
    """The Indel ratio (0 to 100) of two columns' sorted words, rounded; null if a side is null."""
    return F.pandas_udf(_ratios, "int")(a, b)


def _plain_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The Indel ratio (0 to 100) of two columns' texts; null if a side is null."""
    return F.pandas_udf(_plain_ratios, "double")(a, b)


def field_category(a: Column, b: Column) -> Column:
    """The finding of two values of a text field: missing, swap, characters, format, typo, different, or null for none.

    Both blank, or equal but for case and outer blanks, is no finding. swap: I and 1, or O and 0, exchanged;
    characters: other scan errors only; then by the ratio of the upper-case texts: 95 and 85.
    """
    blank = lambda s: F.coalesce(s, F.lit("")) == ""
    x, y = F.trim(a), F.trim(b)
    ratio = indel(F.upper(x), F.upper(y))
    alike = F.when(ratio >= 95, "format").when(ratio >= 85, "typo").otherwise("different")
    told = F.when(F.upper(x) == F.upper(y), None).when(scan_key(x) == scan_key(y), "swap").when(F.size(confused_places(x, y)) > 0, "characters").otherwise(alike)
    return F.when(blank(a) & blank(b), None).when(blank(a) | blank(b), "missing").otherwise(told)


def changed_lines(a: ColumnOrName, b: ColumnOrName, least: float = 90.0) -> Column:
    """(n_changed, n_lines) of two texts' lines that are not blank, held against each other by place.

    A line whose ratio to the other is under ``least`` counts as changed, and so does each line beyond the
    shorter text. Null texts have no line.
    """

    def count(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            left, right = ([line.strip() for line in (t or "").splitlines() if line.strip()] for t in (p, q))
            apart = sum(u != v and indel_ratio(u, v) < least for u, v in zip(left, right))
            rows.append((apart + abs(len(left) - len(right)), max(len(left), len(right))))
        return pd.DataFrame(rows, columns=["n_changed", "n_lines"], dtype="int64")

    return F.pandas_udf(count, "n_changed long, n_lines long")(a, b)


def line_changes(pairs: DataFrame, before: str, after: str, key: str) -> DataFrame:
    """(key, kind, first_line, n_lines): the changed stretches between two texts' lines."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                x, y = (a or "").split("\n"), (b or "").split("\n")
                rows += [(k, tag, i, max(j - i, m - n)) for tag, i, j, n, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if tag != "equal"]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["key", "kind", "first_line", "n_lines"])

    return pairs.select(key, before, after).mapInArrow(run, f"key {kind}, kind string, first_line int, n_lines int")


def best_matches(queries: DataFrame, candidates: DataFrame, block: int = 512) -> DataFrame:
    """(vec_id, match_id): for each query the other candidate of its label with the largest cosine, the smaller id on ties.

    Queries are dealt in blocks to every part of the candidates; a part keeps one row for each query, so what
    is shuffled grows with queries times parts, not with pairs.
    """
    parts, blocks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + queries.count() // block
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "label", "embedding", own(blocks).alias("block"), all_of(parts).alias("part"), F.lit(True).alias("asks"))
    dealt = candidates.select("vec_id", "label", "embedding", all_of(blocks).alias("block"), own(parts).alias("part"), F.lit(False).alias("asks"))

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(x.tolist(), dtype=np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"vec_id": [], "match_id": [], "cosine": []}).astype({"vec_id": "int64", "match_id": "int64", "cosine": "float64"})]
        for _, own_label in rows.groupby("label"):
            q, c = own_label[own_label.asks], own_label[~own_label.asks]
            if q.empty or c.empty:
                continue
            s, ids = np.round(unit(q.embedding) @ unit(c.embedding).T, 9), c.vec_id.to_numpy()
            s[q.vec_id.to_numpy()[:, None] == ids[None, :]] = -2
            first = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, 0]
            out.append(pd.DataFrame({"vec_id": q.vec_id.to_numpy(), "match_id": ids[first], "cosine": s[np.arange(len(q)), first]}))
        return pd.concat(out)

    met = asked.union(dealt).groupBy("block", "part").applyInPandas(run, "vec_id long, match_id long, cosine double")
    best = met.filter("cosine > -2").groupBy("vec_id").agg(F.max(F.struct("cosine", (-F.col("match_id")).alias("match"))).alias("best"))
    return best.select("vec_id", (-F.col("best.match")).alias("match_id"))
