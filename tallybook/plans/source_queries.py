"""Queries of sources, merges and gates (S, F18-F25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import numbers
from ..operators import storage
from .registry import frame, plain, query, table


@query("s03_first_text_that_works", "SELECT doc_id, CASE WHEN length(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE substring(text, 1, 200) END)) > 50 THEN 1 WHEN length(trim(text)) > 50 THEN 2 END AS priority FROM documents WHERE length(trim(text)) > 50")
def s03(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.select("doc_id", F.lit(1).alias("priority"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 1, 200)).alias("text"))
    return sources.first_that_works(first.union(docs.select("doc_id", F.lit(2), "text")), "doc_id", "text", "priority").select("doc_id", "priority")


@query("s07_pipe_table", "SELECT p_partkey AS id, 2 AS row_no, p_brand AS first_cell, CAST(p_size AS VARCHAR) AS second_cell FROM part UNION ALL SELECT p_partkey, 0, 'brand', 'size' FROM part")
def s07(spark: SparkSession, d: str) -> DataFrame:
    drawn = F.concat(F.lit("| brand | size |\n|:---|---|\n| "), "p_brand", F.lit(" |"), F.col("p_size").cast("string"), F.lit("|\ntext"))
    rows = sources.pipe_rows(table(spark, d, "part").select(F.col("p_partkey").alias("id"), drawn.alias("t")), "id", "t")
    return rows.select("id", "row_no", F.get("cells", F.lit(0)).alias("first_cell"), F.get("cells", F.lit(1)).alias("second_cell"))


@query("s10_page_kind", "SELECT page_id, CASE WHEN length(html) < 30 THEN 'OTHER' WHEN contains(html, '/de/') THEN 'A' WHEN contains(html, '</article>') THEN 'B' END AS kind FROM pages")
def s10(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.when(F.length(h) < 30, "OTHER").when(h.contains("/de/"), "A").when(h.contains("</article>"), "B").alias("kind"))


@query("s13_upsert", "WITH n AS (SELECT l_suppkey AS s_suppkey, max(l_orderkey) AS o FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT s.s_suppkey, CASE WHEN n.o IS NULL THEN s_name WHEN n.o % 3 = 0 THEN s_name ELSE concat('new', CAST(n.o AS VARCHAR)) END AS s_name FROM supplier s LEFT JOIN n ON s.s_suppkey = n.s_suppkey")
def s13(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select("s_suppkey", "s_name")
    fresh = table(spark, d, "lineitem").filter("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("new"), F.col("l_orderkey").cast("string"))).alias("s_name"))
    return sources.upsert(old, fresh, ["s_suppkey"], ["l_orderkey"], keep_blank=["s_name"])


@query("s19_changed_files", "SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' END AS change FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def s19(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("digest"))
    state = now.filter("path % 5 <> 0").select("path", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    return sources.changed_files(now, state)


@query("s20_flat_export", "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag <> 'R'")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("s24_safe_cells", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('''=', p_name) WHEN p_partkey % 3 = 1 THEN concat('''@', p_name) ELSE p_name END AS cell FROM part")
def s24(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbers.safe_cell(F.concat(F.when(k == 0, "=").when(k == 1, "@").otherwise(""), "p_name")).alias("cell"))


@query("s30_replace_all", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) UNION ALL SELECT o_orderkey, 0, 1.0 FROM orders WHERE o_orderkey % 10 = 0")
def s30(spark: SparkSession, d: str) -> DataFrame:
    fresh = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast("long").alias("l_partkey"), F.lit(1.0).alias("l_quantity"))
    kept = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(fresh.select("l_orderkey"), "l_orderkey", "left_anti")
    return kept.union(fresh)


@query("f18_missing_documents", "SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS missing FROM (SELECT DISTINCT o_custkey FROM orders) c, (SELECT DISTINCT o_orderpriority AS p FROM orders) q WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND o.o_orderpriority = q.p) GROUP BY o_custkey")
def f18(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    # The kinds of documents are a short fixed list: one row.
    every = orders.agg(F.sort_array(F.collect_set("o_orderpriority")).alias("every"))
    present = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p")).join(F.broadcast(every))
    return present.select("o_custkey", F.array_join(F.array_except("every", "p"), ",").alias("missing")).filter("missing <> ''")


@query("f21_confirm_gate", "SELECT l_orderkey AS job, count(*) FILTER (WHERE l_returnflag <> 'R') > 0 AND NOT bool_or(l_returnflag = 'A' AND l_linestatus = 'O') AS may_confirm FROM lineitem GROUP BY l_orderkey")
def f21(spark: SparkSession, d: str) -> DataFrame:
    ready = (F.count_if(F.col("l_returnflag") != "R") > 0) & ~F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(ready.alias("may_confirm"))


@query("f25_wanted_minus_available", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40")
def f25(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.filter("l_returnflag = 'R'").select("l_partkey").distinct().join(l.filter("l_linestatus = 'O' AND l_quantity > 40").select("l_partkey"), "l_partkey", "left_anti")


#: Cells with separators, quotes and line ends in them.
_UPLOAD = "SELECT p_partkey AS id, concat(p_name, ';', chr(34), p_type, chr(34), CASE WHEN p_partkey % 3 = 0 THEN chr(10) ELSE ', ' END, p_brand) AS name, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS STRING) END AS size FROM {part}"


@query("s11_uploaded_table", f"SELECT CAST(id AS VARCHAR) AS id, name, size FROM ({plain(_UPLOAD)}) u")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """A table written with semicolons, as an upload brings it, and read without being told."""
    path = storage.new_folder(spark, "upload")
    frame(spark, d, _UPLOAD).write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(path)
    return sources.read_table(spark, path)


@query("s21_two_sheets", "SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_orderstatus AS status, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """An export of headers and positions, read back and put together again."""
    path = storage.new_folder(spark, "export")
    header = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("status"))
    positions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    sources.write_sheets({"header": header, "positions": positions}, path)
    return sources.read_sheet(spark, path, "header").join(sources.read_sheet(spark, path, "positions"), "doc")


@query("s31_appended_costs", "SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS tokens, CAST(sum(CAST(CAST((event_id % 1000) * CASE event_type WHEN 'view' THEN 2.5 ELSE 3 END + (event_id % 77) * CASE event_type WHEN 'view' THEN 10 ELSE 15 END AS DECIMAL(18,2)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS usd FROM events GROUP BY event_type", money=("usd",))
def s31(spark: SparkSession, d: str) -> DataFrame:
    """Each call's tokens and cost put behind those before, in two appends, and summed by model."""
    path = storage.new_folder(spark, "usage")
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"), "value")
    cost = numbers.token_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), {"view": (2.5, 10.0)}, (3.0, 15.0))
    for part in (calls.filter("value < 10"), calls.filter("value >= 10 or value is null")):
        sources.append_rows(part.select("model", "tokens_in", cost.alias("cost_usd")), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens"), F.sum("cost_usd").cast("decimal(18,6)").alias("usd"))


@query("s32_file_entries")
def s32(spark: SparkSession, d: str) -> DataFrame:
    """The files of the orders' table: their paths below the folder, and their sizes."""
    return sources.file_entries(spark, d, "*.parquet").filter(F.col("rel_path").startswith("orders.parquet")).select("rel_path", "name", "size", "mtime")
