"""Readers, writers and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import safe_cell

#: Separators that a text table may have.
SEPARATORS = (",", ";", "\t")


#: Characters of a text table in which its separator is looked for.
HEAD = 8192

#: The mark that some programs put before the first character.
BYTE_ORDER_MARK = "\ufeff"


def separator(spark: SparkSession, path: str) -> str:
    """The separator met most often in the first ``HEAD`` characters of the file, or of a folder's first file; the comma if there is none."""
    first = spark.read.format("binaryFile").load(path).filter("length > 0").agg(F.min("path")).first()[0]
    if first is None:
        return SEPARATORS[0]
    # Only the head is read: a query for it would bring whole files to the driver to tell which comes first.
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(first)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    head = bytes(stream.readNBytes(4 * HEAD)).decode("utf-8", "replace")[:HEAD]
    stream.close()
    return max(SEPARATORS, key=lambda c: (head.count(c), -SEPARATORS.index(c)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A text table (a file or a folder of such) with a header, all columns as text; its separator is found out.

    Cells may be quoted; within quotes a doubled quote is one, and separators and line ends are text. A byte order
    mark before the header and blanks around its names go. Empty cells are null, cells that a row lacks too; a
    file without a row gives an empty table. A quoted line end keeps a file in one task: large tables come as folders of files.
    """
    rows = spark.read.option("header", True).option("sep", separator(spark, path)).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.toDF(*(c.lstrip(BYTE_ORDER_MARK).strip() for c in rows.columns))


def append_rows(rows: DataFrame, path: str) -> None:
    """Put rows behind those that a table of the same columns has already; what is there is neither read nor changed."""
    rows.write.mode("append").parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Several tables as one export: a safe text table for each sheet, in a folder of its name."""
    for name, rows in sheets.items():
        write_safe(rows, f"{path.rstrip('/')}/{name}")


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_table(spark, f"{path.rstrip('/')}/{name}")


def file_entries(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(rel_path, name, mtime, size) of all files below a folder whose names fit; their contents are not read.

    ``rel_path`` is the path below ``root``. Folders without such a file give an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    begin = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/") + "/"
    rel = F.substring_index("path", full, -1)
    return begin.select(rel.alias("rel_path"), F.substring_index("path", "/", -1).alias("name"), "mtime", "size")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], keep_blank: Sequence[str] = ()) -> DataFrame:
    """The old rows with the new ones put over them; of new rows of one key the last in the order counts.

    Columns in ``keep_blank``: a blank or null new value does not replace an old one. Keys match null-safe.
    """
    values = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*order, *(F.col(c).alias("_v_" + c) for c in values))).alias("n")).select(*(F.col(k).alias("_k_" + k) for k in keys), "n", F.lit(True).alias("_new"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    joined = old.withColumn("_old", F.lit(True)).join(last, same, "full")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.coalesce(F.nullif(F.trim(F.col(f"n._v_{c}").cast("string")), F.lit("")).cast(old.schema[c].dataType), F.col(c)) if c in keep_blank else F.col(f"n._v_{c}"))
    return joined.select(*(F.when(F.col("_old").isNull(), F.col("_k_" + k)).otherwise(F.col(k)).alias(k) for k in keys), *(pick(c).alias(c) for c in values))


def changed_files(files: DataFrame, state: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(path, change): new, changed or gone against the stored state."""
    now, before = files.select(path, F.col(digest).alias("_now")), state.select(path, F.col(digest).alias("_before"))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_before"), "changed")
    return now.join(before, path, "full").select(path, change.alias("change")).filter("change is not null")


def first_that_works(candidates: DataFrame, key: str, text: str, priority: str, least: int = 50) -> DataFrame:
    """For each key the text of the first priority with over ``least`` characters."""
    good = candidates.filter(F.length(F.trim(text)) > least)
    return good.groupBy(key).agg(F.min(F.struct(priority, text)).alias("_m")).select(key, f"_m.{priority}", f"_m.{text}")


def write_safe(df: DataFrame, path: str) -> None:
    """A CSV table whose cells no spreadsheet takes for formulas."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    df.select(*(safe_cell(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def pipe_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, cells): the rows of a table drawn with pipes, without its rule lines."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^[\s|:\-]+$"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return lines.select(key, F.col("line_no").alias("row_no"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))
