"""Queries of findings in texts, references and header fields, whose ratios SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers, similarity
from ..operators import compare, linkage
from .fixtures import ITEMS_A, ITEMS_B, REFS
from .registry import frame, query, table


@query("m06_missing_refs_by_ratio")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """References of document A that B has not, judged by B's most alike one."""
    return linkage.missing_refs(frame(spark, d, ITEMS_A), frame(spark, d, ITEMS_B), "doc", "ref")


@query("m07_text_field_findings")
def m07(spark: SparkSession, d: str) -> DataFrame:
    """The category of two readings of each reference; null where they agree."""
    return frame(spark, d, REFS).select("id", similarity.field_category(F.col("raw"), F.col("other")).alias("category"))


@query("m15_changed_lines_by_ratio")
def m15(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines against those of the next."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(after, "doc_id").withColumn("c", similarity.changed_lines("text", "next")).select("doc_id", "c.n_changed", "c.n_lines")


#: Two notations of the header fields of each order: date, payment terms, amount and clerk.
_HEADERS = """SELECT o_orderkey AS doc, f.field, f.a, f.b FROM {orders} LATERAL VIEW explode(array(
  named_struct('field', 'date', 'a', date_format(o_orderdate, 'yyyy-MM-dd'), 'b', CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 2 THEN date_format(date_add(o_orderdate, 1), 'yyyy-MM-dd') END),
  named_struct('field', 'payment', 'a', CASE WHEN o_orderkey % 3 = 0 THEN 'NT30' ELSE 'net 60 days' END, 'b', CASE o_orderkey % 5 WHEN 0 THEN '30 days net' WHEN 1 THEN '60 days' WHEN 2 THEN 'in advance' ELSE 'NET 60 DAYS ' END),
  named_struct('field', 'amount', 'a', format_number(o_totalprice, 2), 'b', CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS STRING) END),
  named_struct('field', 'priority', 'a', o_orderpriority, 'b', CASE o_orderkey % 4 WHEN 0 THEN replace(o_orderpriority, '-', ' ') WHEN 1 THEN concat(o_orderpriority, 'X') WHEN 2 THEN o_orderstatus ELSE upper(o_orderpriority) END))) x AS f"""


@query("c04_second_header_rules")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, _HEADERS).select("doc", "field", compare.header_verdict(F.col("field"), F.col("a"), F.col("b")).alias("verdict"))


#: Header rows of each order's table: six of some twenty headers, by the order's number.
_COLUMNS = """SELECT o_orderkey AS doc, transform(sequence(0, 5), k -> element_at(array('No.', 'Item code', 'Description of goods', 'Qty', 'Unit price', 'Net weight', 'Gross weight', 'Amount', 'Total value', 'UOM', 'Batch', 'HS code', 'VAT', 'Origin', 'Remarks', '35', ' QTY ', 'unit', 'Kod CN', 'nazwa'),
  CAST((o_orderkey * (k + 3) + k * k) % 20 AS INT) + 1)) AS headers FROM {orders}"""


@query("w19_column_roles_in_order")
def w19(spark: SparkSession, d: str) -> DataFrame:
    roles = headers.column_roles(F.col("headers"))
    return frame(spark, d, _COLUMNS).select("doc", F.posexplode(F.arrays_zip("headers", roles.alias("roles"))).alias("place", "c")).select("doc", "place", F.col("c.headers").alias("header"), F.col("c.roles").alias("role"))
