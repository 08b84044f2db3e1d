"""Near-duplicate embeddings by NN-descent.

A graph of each vector's nearest neighbours starts from random projections and is refined by comparing
every vector's neighbours, and those it is a neighbour of, with each other. Lists full of links are
enlarged. Every link met on the way joins two groups; in the end all pairs inside a group are compared in
tiles, so that numbers of links do not depend on the lists' lengths. An audit measures the recall against
brute force, and the descent goes on with longer lists while it is too low; if it stays too low all vectors
of a label are compared in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidied, whole_groups
from .components import components
from .simhash import _join

THRESHOLD = 0.93
NEIGHBOURS = 8
MOST_NEIGHBOURS = 32
TABLES = 5
ROUNDS = 5
#: The descent ends when fewer of the lists' entries are new.
SETTLED = 0.02
#: Vectors of one bucket or group that meet in one tile.
TILE = 1024
#: Vectors in a tile of the exact comparison; a vector is sent to as many tiles as its group has.
WIDE_TILE = 4096
#: Vectors audited in each of two draws, from all and from those of few links, by brute force. A draw is doubled up to
#: MOST_AUDITED until LINKED of its vectors have a link. RECALL of them must have all of their links found.
AUDIT = 400
MOST_AUDITED = 6400
LINKED = 100
FEW_LINKS = 64
RECALL = 0.99


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, part, vec): the vectors that can link, as bytes; ``part`` tells label and dimension."""
    bounded_batches(vectors.sparkSession)
    double = "double" in vectors.schema[vector_column].dataType.simpleString()
    number = np.dtype("<f8" if double else "<f4")
    v = F.col(vector_column).cast("array<double>" if double else "array<float>")
    fit = F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(fit).select(F.col(id_column).cast("long").alias("id"), F.concat_ws(":", F.col(label_column).cast("string"), F.size(v).cast("string")).alias("part"), v.alias("v"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edges = batch.column(2).values.to_numpy(zero_copy_only=False).astype(number) + number.type(0), batch.column(2).offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["id", "part", "vec"])

    return rows.mapInArrow(run, "id long, part string, vec binary").withColumn("wide", F.lit(double))


def _matrix(column: pa.ChunkedArray | pa.Array, wide: bool) -> np.ndarray:
    """Unit vectors in double precision, of one dimension."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8" if wide else "<f4").astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tiles(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The rows with ``tiles``: how many tiles of about ``size`` rows their key's rows make."""
    large = rows.groupBy(key).count().filter(F.col("count") > size).select(key, F.ceil(F.col("count") / size).cast("int").alias("tiles"))
    return rows.join(large, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))


def _first_lists(nodes: DataFrame, wide: bool, threshold: float, tables: int) -> DataFrame:
    """(node, nbr, sim, link): for each vector its best among those beside it in random projections, and links."""
    bits = max(1, int(np.ceil(np.log2(max(2, nodes.count() / 500)))))

    @tidied
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            parts, vecs = batch.column(1).to_pylist(), batch.column(2)
            sizes = np.array([len(v.as_py()) for v in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(vecs.take(pa.array(at)), wide)
                if size not in planes:
                    planes[size] = np.random.default_rng(7).standard_normal((tables, bits + 1, x.shape[1]))
                for t in range(tables):
                    p = x @ planes[size][t].T
                    mark = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{parts[k]}/{t}/{m}" for k, m in zip(at, mark, strict=True)]), pa.array(p[:, bits]), batch.column(0).take(pa.array(at)), vecs.take(pa.array(at))],
                        names=["bucket", "place", "rep", "vec"],
                    )

    placed = nodes.select("rep", "part", "vec").mapInArrow(project, "bucket string, place double, rep long, vec binary")
    dealt = _tiles(placed, "bucket", TILE).select(F.xxhash64("bucket", F.pmod(F.xxhash64("rep"), F.col("tiles"))).alias("unit"), "place", "rep", "vec")
    reach, keep = 8, 4

    @tidied
    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 2048):
            unit, rep = table.column("unit").to_numpy(), table.column("rep").to_numpy()
            sizes = [len(v) for v in table.column("vec").to_pylist()]
            if len(set(sizes)) > 1:  # buckets of several dimensions
                groups = [table.filter(pa.array([s == size for s in sizes])) for size in set(sizes)]
            else:
                groups = [table]
            for table in groups:
                unit, rep, x = table.column("unit").to_numpy(), table.column("rep").to_numpy(), _matrix(table.column("vec"), wide)
                n = len(rep)
                sims, label = np.full((n, 2 * reach), -2.0), np.arange(n)
                for step in range(1, min(reach, n - 1) + 1):
                    same = np.flatnonzero(unit[:-step] == unit[step:])
                    s = np.einsum("ij,ij->i", x[same], x[same + step])
                    sims[same, step - 1] = s
                    sims[same + step, reach + step - 1] = s
                    near = same[s >= threshold]
                    _join(label, near, near + step)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
                row = np.repeat(np.arange(n), keep)
                column = best.ravel()
                good = sims[row, column] > -2
                row, column = row[good], column[good]
                other = row + np.where(column < reach, column + 1, reach - column - 1)
                moved = np.flatnonzero(label != np.arange(n))
                yield _batch(rep, row, other, sims[row, column], moved, label[moved])

    return dealt.repartition("unit").sortWithinPartitions("unit", "place").mapInArrow(beside, _FOUND)


_FOUND = "node long, nbr long, sim double, link boolean"


def _batch(rep: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray, la: np.ndarray, lb: np.ndarray) -> pa.RecordBatch:
    """Candidates (a, b, sim) and links (la, lb), as rows of their ids."""
    link = np.r_[np.zeros(len(a), bool), np.ones(len(la), bool)]
    return pa.RecordBatch.from_arrays([pa.array(rep[np.r_[a, la]]), pa.array(rep[np.r_[b, lb]]), pa.array(np.r_[sim, np.ones(len(la))]), pa.array(link)], names=["node", "nbr", "sim", "link"])


def _lists(found: DataFrame, room: DataFrame | None, k: int) -> DataFrame:
    """(node, nbr, sim, fresh): each node's best neighbours, ``k`` or its own room."""
    once = found.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")))
    if room is not None:
        return ranked.filter(F.col("rank") <= MOST_NEIGHBOURS).join(room, "node", "left").filter(F.col("rank") <= F.coalesce("room", F.lit(k))).select("node", "nbr", "sim", "fresh")
    return ranked.filter(F.col("rank") <= k).select("node", "nbr", "sim", "fresh")


def _local_joins(nodes: DataFrame, lists: DataFrame, wide: bool, threshold: float, k: int) -> DataFrame:
    """(node, nbr, sim, link): what comparing the neighbours of each vector with each other brings."""
    last = lists.groupBy("node").agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("n"))
    state = nodes.select("rep", "vec").join(last.select(F.col("node").alias("rep"), F.when(F.col("n") >= k, F.col("last")).otherwise(-2.0).alias("last")), "rep", "left")
    turned = lists.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", "fresh")
    both = lists.union(turned).groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.max(F.col("fresh")).alias("fresh"))
    near = both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).filter(F.col("rank") <= 2 * MOST_NEIGHBOURS)
    members = near.select(F.col("node").alias("center"), F.col("nbr").alias("rep"), "fresh").join(state, "rep").select("center", "rep", "fresh", F.coalesce("last", F.lit(-2.0)).alias("last"), "vec")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "center", 2048):
            center, rep, fresh, last = (table.column(c).to_numpy() for c in ("center", "rep", "fresh", "last"))
            x = _matrix(table.column("vec"), wide) if len({len(v) for v in table.column("vec").to_pylist()}) == 1 else None
            edges = np.flatnonzero(np.r_[True, center[1:] != center[:-1], True])
            label, found = np.arange(len(rep)), []
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                m = x[a:b] if x is not None else _matrix(table.column("vec").slice(a, b - a), wide)
                s = m @ m.T
                s[~(fresh[a:b, None] | fresh[None, a:b])] = -2
                np.fill_diagonal(s, -2)
                i, j = np.nonzero(s > last[a:b, None])
                found.append((i + a, j + a, s[i, j]))
                i, j = np.nonzero(np.triu(s >= threshold))
                _join(label, i + a, j + a)
            moved = np.flatnonzero(label != np.arange(len(rep)))
            i, j, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (moved[:0], moved[:0], np.empty(0))
            yield _batch(rep, i, j, s, moved, label[moved])

    return members.repartition("center").sortWithinPartitions("center").mapInArrow(run, _FOUND)


def _compared(members: DataFrame, wide: bool, threshold: float) -> DataFrame:
    """(node, n, other): all pairs of each group of ``members`` (group, rep, copies, vec), in tiles.

    Rows with ``n`` add up to the copies of the other nodes of the group that the node links to; those with
    ``other`` are links that span the group's parts.
    """
    tiled = _tiles(members, "group", WIDE_TILE).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    units = tiled.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), side.alias("side"), "rep", "copies", "vec")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 2048):
            unit, side, rep, copies = (table.column(c).to_numpy() for c in ("unit", "side", "rep", "copies"))
            edges, n, label = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True]), np.zeros(len(rep), np.int64), np.arange(len(rep))
            for a, b in zip(edges, edges[1:], strict=False):
                m = _matrix(table.column("vec").slice(a, b - a), wide)
                k = int((side[a:b] == 0).sum())
                rows = b - a if side[a] == 2 else k
                for begin in range(0, rows, 512):
                    end = min(rows, begin + 512)
                    at = 0 if side[a] == 2 else k
                    s = m[begin:end] @ m[at:].T >= threshold
                    if side[a] == 2:
                        s[np.arange(end - begin), np.arange(begin, end)] = False
                    else:
                        n[a + k : b] += s.T @ copies[a + begin : a + end]
                    n[a + begin : a + end] += s @ copies[a + at : b]
                    i, j = np.nonzero(s)
                    _join(label, i + a + begin, j + a + at)
            moved = np.flatnonzero(label != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.nulls(len(rep), pa.int64())], names=["node", "n", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.nulls(len(moved), pa.int64()), pa.array(rep[label[moved]])], names=["node", "n", "other"])

    return units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "node long, n long, other long")


def audit(nodes: DataFrame, counted: DataFrame, wide: bool, threshold: float, sample: int = AUDIT) -> float:
    """Of sampled vectors that have a link by brute force the share whose links ``counted`` has all, the lesser of two draws.

    One draw is from all vectors, one from those with few links in ``counted`` or none, so that a large
    group cannot hide what is lost elsewhere; a vector counts once however many copies its links have.
    Vectors come in the order of a hash of their ids. 1 where no drawn vector has a link.
    """
    known = nodes.join(counted, F.col("rep") == F.col("node"), "left").select("rep", "part", "vec", F.coalesce("n", F.lit(0)).alias("n"))
    return min(_drawn_recall(nodes, drawn, wide, threshold, sample) for drawn in (known, known.filter(F.col("n") <= FEW_LINKS)))


def _drawn_recall(nodes: DataFrame, drawn: DataFrame, wide: bool, threshold: float, sample: int) -> float:
    while True:
        asked = drawn.orderBy(F.xxhash64("rep", F.lit("audit")), "rep").limit(sample).toArrow()
        true = _true_links(nodes, asked, wide, threshold)
        linked = [true.get(r, 0) == n for r, n in zip(asked.column("rep").to_pylist(), asked.column("n").to_pylist(), strict=True) if true.get(r, 0)]
        if len(linked) >= LINKED or asked.num_rows < sample or sample >= MOST_AUDITED:
            return sum(linked) / len(linked) if linked else 1.0
        sample *= 4


def _true_links(nodes: DataFrame, asked: pa.Table, wide: bool, threshold: float) -> dict[int, int]:
    """The copies that each asked vector (rep, part, vec) links to, by brute force over all nodes; at most MOST_AUDITED numbers."""
    queries = list(zip(*(asked.column(c).to_pylist() for c in ("rep", "part", "vec")), strict=True))
    parts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in {p for _, p, _ in queries}:
        own = [(r, v) for r, p, v in queries if p == part]
        parts[part] = (np.array([r for r, _ in own]), _matrix(pa.array([v for _, v in own], pa.binary()), wide))
    shared = nodes.sparkSession.sparkContext.broadcast(parts)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.array(batch.column(1).to_pylist(), object)
            for name, (ids, q) in shared.value.items():
                at = np.flatnonzero(part == name)
                if not len(at):
                    continue
                rep, copies = batch.column(0).to_numpy()[at], batch.column(3).to_numpy()[at]
                m = _matrix(batch.column(2).take(pa.array(at)), wide)
                for begin in range(0, len(ids), 1000):
                    own = ids[begin : begin + 1000]
                    s = (q[begin : begin + 1000] @ m.T >= threshold) & (own[:, None] != rep[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(s @ copies)], names=["node", "n"])

    found = nodes.select("rep", "part", "vec", "copies").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("node").to_pylist(), found.column("n").to_pylist(), strict=True))


def linked(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    recall: float = RECALL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): the links of each vector to others of its label with cosine ``threshold`` or more.

    ``n_links`` counts all other vectors linked directly, equal ones included, all of one found group
    compared exactly; ``component_id`` is the smallest id reached by links.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
    link with nothing, like those whose label none shares; vectors of other dimensions do not link. Rows
    with equal ids each keep a row. A null id links with nothing and is its own (null) component, kept
    false. An empty table gives an empty result.
    """
    base = stored(usable(vectors, id_column, vector_column, label_column), "vectors")
    first = base.select("wide").limit(1).collect()
    wide = bool(first and first[0][0])
    nodes = stored(base.groupBy("part", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes")
    k = neighbours
    found = stored(_first_lists(nodes, wide, threshold, TABLES), "found")
    edges = found.filter("link").select("node", "nbr")
    lists = stored(_lists(found.filter("not link").select("node", "nbr", "sim", F.lit(True).alias("fresh")), None, k), "lists")
    while True:
        for _ in range(ROUNDS):
            found = stored(_local_joins(nodes, lists, wide, threshold, k), "found")
            edges = edges.union(found.filter("link").select("node", "nbr"))
            # A list full of links gets twice the room.
            full = lists.groupBy("node").agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("n")).filter((F.col("last") >= threshold) & (F.col("n") >= k))
            room = full.select("node", F.least(F.lit(MOST_NEIGHBOURS), 2 * F.col("n")).cast("int").alias("room"))
            known = lists.select("node", "nbr", "sim", F.lit(False).alias("fresh")).union(found.filter("not link").select("node", "nbr", "sim", F.lit(True).alias("fresh")))
            old, lists = lists, stored(_lists(known, room, k), "lists")
            share = lists.agg(F.avg(F.col("fresh").cast("double"))).first()[0] or 0.0
            forget(old)
            if share < SETTLED:
                break
        groups = stored(components(edges.toDF("a", "b")), "groups")
        members = nodes.join(groups, F.col("rep") == F.col("node")).select(F.col("component").alias("group"), "rep", "copies", "vec")
        counted = stored(_compared(stored(members, "members"), wide, threshold).filter("n is not null").groupBy("node").agg(F.sum("n").alias("n")), "counted")
        if audit(nodes, counted, wide, threshold) >= recall:
            break
        if k >= MOST_NEIGHBOURS:
            # The descent does not find enough: the exact way, all vectors of a label and dimension as one group.
            found = stored(_compared(nodes.select(F.col("part").alias("group"), "rep", "copies", "vec"), wide, threshold), "exact")
            counted = stored(found.filter("n is not null").groupBy("node").agg(F.sum("n").alias("n")), "counted")
            groups = stored(components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "groups")
            break
        k = min(MOST_NEIGHBOURS, 2 * k)
        lists = stored(lists.withColumn("fresh", F.lit(True)), "lists")
    of_node = nodes.join(counted, F.col("rep") == F.col("node"), "left").drop("node").join(groups, F.col("rep") == F.col("node"), "left")
    of_node = stored(of_node.select("part", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "of-node")
    of_id = base.join(of_node, ["part", "vec"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id"))
    out = ids.join(of_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
