"""What the operators share: tables in the shared folder, batch sizes, and grouping of Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in a batch that goes to a Python worker. Rows of any length then need bounded memory.
BATCH_BYTES = 3 << 20
BATCH_ROWS = 2000

def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else one in the warehouse, which is shared too.

    Where both are unset the session's warehouse is a folder of the working folder: only a session on one
    machine may do with that, and any other is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.tallybook"
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/tallybook-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: what comes later survives lost executors without computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallybook_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing will read again."""
    spark, path = df.sparkSession, df._tallybook_path
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, in rows and bytes, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's function; at its end the worker, which lives on for later tasks, gives free memory back."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


_NO_WORDS = re.compile(r"[\W\d_]+")


def letters_of(text: bytes) -> str:
    """The text's letters in lower case, all else between them as one blank; empty if there is no letter."""
    letters = _NO_WORDS.sub(" ", text.decode("utf-8", "replace").lower()).strip()
    if not letters.replace(" ", "").isalpha():
        # Number signs like ½ and Ⅷ are words to a pattern, but no letters.
        letters = " ".join("".join(c if c.isalpha() else " " for c in letters).split())
    return letters


def utf8(column: str | Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty. Bytes reach Python without decoding."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("binary"), F.lit(b""))


def whole(documents: DataFrame) -> Column:
    """A row with all its columns as one, so that no name of the caller's meets one of the operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document")


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least_rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``least_rows`` rows (but the last) from batches sorted by ``key``, no key's rows cut apart."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        last = int(keys.searchsorted(keys[-1], "left")) if keys[0] <= keys[-1] else 0
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
            rows -= last
    if held:
        yield pa.Table.from_batches(held)
