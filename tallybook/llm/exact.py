"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content, and a bucket that is too large is dealt again, with a
fresh hash, to spill tables in the shared folder, until each fits an open-addressing table. The table compares
complete contents, so the hash only decides where two contents meet, never whether they are equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidied, utf8

#: Bytes of content that one bucket may have.
BUCKET_BYTES = 32 << 20
#: Parts that a bucket which is too large is dealt to.
FAN_OUT = 16
#: Rows of a part, where one content (or hash) alone makes a bucket too large.
PART_ROWS = 256
#: A task's own table is handed on when it holds so many bytes of content, or so many rows came.
LOCAL_BYTES = 16 << 20
LOCAL_ROWS = 100_000

_WHITE = b" \t\n\r\x0b\x0c"
Hash = Callable[[bytes], int]


def normalised(text: bytes) -> bytes:
    """Each run of white space (ASCII 9 to 13 and 32) as one blank, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b"".join((b" " if text[0] in _WHITE else b"", b" ".join(words), b" " if text[-1] in _WHITE else b""))


class ContentTable:
    """An open-addressing table of contents with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents, self.size = [-1] * 64, [], [], 0

    def place(self, h: int, content: bytes) -> int:
        """The number of the content's entry; a content that is not held yet becomes the next entry."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        k = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.size += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def records(documents: DataFrame, row: Column, id_column: str, text_column: str, hashed: Hash, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(key, h, size, least, n, ids, rows, content): the distinct contents of each stretch of a task's rows.

    ``ids`` and ``rows`` belong to the stretch's rows of that content, smallest id first (null ids last, ties
    by row). A content of very many copies leaves one record for each stretch. ``key`` numbers the records of
    one run; the caller stores the table, so that keys stay.
    """
    bounded_batches(documents.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, members, seen, key = ContentTable(), [], 0, TaskContext.get().partitionId() << 36

        def handed_on() -> pa.RecordBatch:
            nonlocal key
            listed = [sorted(m, key=lambda x: (x[0] is None, x[0] or 0, x[1] or 0)) for m in members]
            keys = range(key, key + len(listed))
            key += len(listed)
            columns = [
                pa.array(keys, pa.int64()),
                pa.array(map(_signed, table.hashes), pa.int64()),
                pa.array(map(len, table.contents), pa.int64()),
                pa.array((m[0][0] for m in listed), pa.int64()),
                pa.array(map(len, listed), pa.int64()),
                pa.array(([x[0] for x in m] for m in listed), pa.list_(pa.int64())),
                pa.array(([x[1] for x in m] for m in listed), pa.list_(pa.int64())),
                pa.array(table.contents, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["key", "h", "size", "least", "n", "ids", "rows", "content"])

        for batch in batches:
            for i, r, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = normalised(text)
                k = table.place(hashed(content), content)
                if k == len(members):
                    members.append([])
                members[k].append((i, r))
                seen += 1
                if table.size >= local_bytes or seen >= LOCAL_ROWS:
                    yield handed_on()
                    table, members, seen = ContentTable(), [], 0
        if members:
            yield handed_on()

    rows = documents.select(F.col(id_column).cast("long").alias("id"), row.cast("long").alias("row"), utf8(text_column).alias("text"))
    return rows.mapInArrow(run, "key long, h long, size long, least long, n long, ids array<long>, rows array<long>, content binary")


def _met(level: DataFrame) -> DataFrame:
    """(key, rep, least, best, n, digest): each record with what its bucket's table says of its content.

    ``rep`` is the content's first record in the table, ``best`` the record that holds the smallest id. A task
    takes the buckets of its partition one after another, with one table at a time.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, keys, places, facts = None, ContentTable(), [], [], []

        def told() -> pa.RecordBatch:
            digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
            of = [facts[p] for p in places]
            columns = [pa.array(keys, pa.int64()), *(pa.array((f[k] for f in of), pa.int64()) for k in range(4)), pa.array((digests[p] for p in places), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "rep", "least", "best", "n", "digest"])

        for batch in batches:
            for b, key, h, least, best, n, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if keys:
                        yield told()
                    bucket, table, keys, places, facts = b, ContentTable(), [], [], []
                p = table.place(h & 0xFFFFFFFFFFFFFFFF, content)
                keys.append(key)
                places.append(p)
                if p == len(facts):
                    facts.append([key, least, best, n])
                    continue
                old = facts[p]
                old[3] += n
                if (least is None, least or 0, best) < (old[1] is None, old[1] or 0, old[2]):
                    old[1:3] = least, best
        if keys:
            yield told()

    dealt = level.select("bucket", "key", "h", "least", "best", "n", "content").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key long, rep long, least long, best long, n long, digest string")


def matched(found: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, least, best, n, digest): the class of equal contents of each of ``records``, a stored table; stored.

    The first dealing has as many buckets as the bytes need. What is still too large is written as a spill table
    and dealt again by a hash of the hash; where all of a bucket has one hash (copies, or different contents
    by chance), its records are dealt in parts by key, each part keeps one record of each content, and those
    meet again, so no task gets all copies of one content.
    """
    spark = found.sparkSession
    total = found.agg(F.sum("size"), F.count("*")).first()
    buckets = max(math.ceil(2 * (total[0] or 0) / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    level = found.select("key", "h", "size", "least", F.col("key").alias("best"), "n", "content", F.pmod("h", F.lit(buckets)).alias("bucket"))
    spilled: list[DataFrame] = []
    classes: list[DataFrame] = []
    parts: list[DataFrame] = []
    depth = 0
    while True:
        sizes = level.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.min("h") == F.max("h")).alias("one_hash"))
        over = stored(sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("rows") > 1) & (~F.col("one_hash") | (F.col("rows") > part_rows))), "too-large")
        if not over.limit(1).count():
            classes.append(_met(level))
            forget(over)
            break
        classes.append(_met(level.join(over, "bucket", "left_anti")))
        again = level.join(over.select("bucket", "one_hash", "rows"), "bucket")
        deeper = again.filter(~F.col("one_hash")).withColumn("bucket", F.col("bucket") * fan_out + F.pmod(F.xxhash64("h", F.lit(depth)), F.lit(fan_out)))
        one = stored(again.filter("one_hash").withColumn("home", F.col("bucket") * fan_out).withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("key", F.lit(depth)), F.ceil(F.col("rows") / part_rows)))), "one-hash")
        part = stored(_met(one), "parts")
        parts.append(part)
        # Should different contents have one hash, their digests part them from here on.
        left = one.drop("least", "best", "n", "h").join(part.filter("key = rep").select("key", "least", "best", "n", F.xxhash64("digest").alias("h")), "key").withColumn("bucket", F.col("home"))
        level = stored(deeper.select(*level.columns).union(left.select(*level.columns)), "spill")
        forget(one)
        spilled += [level, over]
        depth += 1
    out = stored(_union(classes).select("key", "least", "best", "n", "digest"), "classes")
    for part in reversed(parts):
        # A record that stood for its part knows the class; those behind it take it over.
        behind = part.filter("key <> rep").select("key", "rep")
        fresh = stored(out.union(behind.join(out.withColumnRenamed("key", "rep"), "rep").select(*out.columns)), "classes")
        forget(out)
        forget(part)
        out = fresh
    for table in spilled:
        forget(table)
    return out


def _union(tables: Iterable[DataFrame]) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.union(t)
    return first


def groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", row: Column | None = None, hashed: Hash = xxhash.xxh3_64_intdigest, bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT, part_rows: int = PART_ROWS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(id, row, keep_id, group_size, kept, digest): a row for each document, with the group of equal texts it is in.

    Texts are equal when identical after replacing each run of white space by one blank; null counts as empty.
    The row of the smallest id stays: exactly one of each group, also where rows repeat its id (the least
    ``row`` then, or any). Null ids come last: a row without id stays only where its group has no id, and
    then ``keep_id`` is null. Empty tables give no rows; other columns are not looked at. ``digest`` is the SHA-256 of the
    normalised text; no decision rests on it. Texts of any length pass as they are.
    """
    found = stored(records(documents, F.lit(None) if row is None else row, id_column, text_column, hashed, local_bytes), "records")
    classes = matched(found, bucket_bytes, fan_out, part_rows)
    joined = found.select("key", F.arrays_zip("ids", "rows").alias("members")).join(classes, "key")
    listed = joined.select("key", "least", "best", "n", "digest", F.posexplode("members").alias("place", "member"))
    kept = (F.col("key") == F.col("best")) & (F.col("place") == 0)
    out = stored(listed.select(F.col("member.ids").alias("id"), F.col("member.rows").alias("row"), F.col("least").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest"), "exact-groups")
    forget(found)
    forget(classes)
    return out


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **sizes: int) -> DataFrame:
    """The documents that stay, one of each group of equal texts, whole and with all their columns."""
    rows = stored(documents.select(F.struct(*documents.columns).alias("document"), F.monotonically_increasing_id().alias("row")), "rows")
    plain = rows.select(F.col("document")[id_column].alias("id"), F.col("document")[text_column].alias("text"), "row")
    stay = groups(plain, "id", "text", F.col("row"), **sizes).filter("kept").select("row")
    return rows.join(stay, "row", "left_semi").select("document.*")
