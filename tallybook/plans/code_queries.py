"""Queries over barcodes and customs codes (T15-T27, C09, C10, C20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from .fixtures import CODES
from .registry import frame, plain, query, table

_CODES = f"WITH f AS ({plain(CODES)}), g AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM f) "


def _valid_sql(s: str) -> str:
    figure = f"CAST(substring(reverse({s}), CAST(i AS BIGINT), 1) AS INT)"
    return f"(length({s}) IN (8, 12, 13, 14) AND list_sum(list_transform(range(1, length({s}) + 1), lambda i: {figure} * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0)"


@query("t15_digits_only", _CODES + "SELECT id, d FROM g")
def t15(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.digits_only(F.col("code")).alias("d"))


@query("t17_clean_ean", _CODES + "SELECT id, CASE WHEN length(d) IN (8, 13, 14) THEN d ELSE '' END AS ean FROM g")
def t17(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.clean_ean(F.col("code")).alias("ean"))


@query("t18_check_digit", _CODES + "SELECT id, CAST(k AS INT) AS digit FROM g")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.check_digit(F.col("b")).alias("digit"))


@query("t21_barcode_kind", _CODES + f"SELECT id, CASE length(d) WHEN 8 THEN 'EAN-8' WHEN 12 THEN 'UPC-A' WHEN 13 THEN 'EAN-13' WHEN 14 THEN 'GTIN-14' ELSE 'unknown' END AS kind, {_valid_sql('d')} AS valid FROM g")
def t21(spark: SparkSession, d: str) -> DataFrame:
    kind = codes.barcode_kind(F.col("code"))
    return frame(spark, d, CODES).select("id", kind["kind"].alias("kind"), kind["valid"].alias("valid"))


@query("t25_padded_ean", _CODES + "SELECT id, CASE WHEN length(d) = 14 AND d LIKE '0%' THEN substring(d, 2, 13) WHEN length(d) < 13 THEN lpad(d, 13, '0') ELSE d END AS padded, CASE WHEN length(d) = 12 THEN concat('0', d) WHEN length(d) = 14 AND d LIKE '0%' THEN substring(d, 2, 13) ELSE d END AS ean13 FROM g")
def t25(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.padded_ean(F.col("code")).alias("padded"), codes.ean13_of(F.col("code")).alias("ean13"))


@query("t23_gs1_bracketed", _CODES + "SELECT id, CASE WHEN id % 3 = 0 THEN b || k END AS gtin, CASE WHEN id % 4 = 0 THEN '240131' END AS expiry, 'L' || CAST(id AS VARCHAR) AS lot, concat_ws(',', CASE WHEN id % 3 <> 0 THEN '01' END, CASE WHEN id % 4 <> 0 THEN '17' END) AS missing FROM g")
def t23(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(F.col("id") % 3 == 0, F.concat(F.lit("(01)"), "b", "k")).otherwise(""), F.when(F.col("id") % 4 == 0, "(17)240131").otherwise(""), F.lit("(10) L"), F.col("id").cast("string"))
    found = codes.gs1_bracketed(raw)
    rows = frame(spark, d, CODES).select("id", found.alias("ai"))
    return rows.select("id", F.try_element_at("ai", F.lit("01")).alias("gtin"), F.try_element_at("ai", F.lit("17")).alias("expiry"), F.try_element_at("ai", F.lit("10")).alias("lot"), F.array_join(codes.gs1_missing(F.col("ai")), ",").alias("missing"))


_CUSTOMS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN lpad(CAST(p_partkey * 7919 % 100000000 AS STRING), 8, '0') WHEN 1 THEN concat('3304 ', lpad(CAST(p_size AS STRING), 4, '0')) WHEN 2 THEN '99ab' WHEN 3 THEN '' WHEN 4 THEN '7701.20' ELSE '0012345678' END AS code FROM {part}"


@query("t16_customs_code", f"WITH f AS ({plain(_CUSTOMS)}), g AS (SELECT id, code, regexp_replace(code, '[^0-9]', '', 'g') AS d, regexp_replace(code, '[0-9\\s.\\-]', '', 'g') AS letters FROM f) SELECT id, CASE WHEN trim(code) = '' THEN 'warning' WHEN letters <> '' OR length(d) NOT IN (6, 8, 10) OR d LIKE '00%' THEN 'error' WHEN substring(d, 1, 2) IN ('77', '98', '99') THEN 'warning' ELSE 'ok' END AS status FROM g")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, _CUSTOMS).select("id", codes.customs_code_check(F.col("code"))["status"].alias("status"))


@query("c09_customs_codes_agree", f"WITH f AS ({plain(_CUSTOMS)}), g AS (SELECT id, regexp_replace(code, '[^0-9]', '', 'g') AS a, CASE id % 4 WHEN 0 THEN regexp_replace(code, '[^0-9]', '', 'g') WHEN 1 THEN concat(regexp_replace(code, '[^0-9]', '', 'g'), '10') WHEN 2 THEN '' ELSE '12345678' END AS b FROM f) SELECT id, CASE WHEN a = '' OR b = '' THEN 'missing' WHEN a = b THEN 'same' WHEN least(length(a), length(b)) >= 8 AND substring(a, 1, least(length(a), length(b))) = substring(b, 1, least(length(a), length(b))) THEN 'prefix' ELSE 'different' END AS verdict FROM g")
def c09(spark: SparkSession, d: str) -> DataFrame:
    a = codes.digits_only(F.col("code"))
    b = F.when(F.col("id") % 4 == 0, a).when(F.col("id") % 4 == 1, F.concat(a, F.lit("10"))).when(F.col("id") % 4 == 2, "").otherwise("12345678")
    return frame(spark, d, _CUSTOMS).select("id", codes.customs_codes_agree(F.col("code"), b).alias("verdict"))


@query("c10_customs_reference", f"WITH f AS ({plain(_CUSTOMS)}), r AS (SELECT DISTINCT regexp_replace(code, '[^0-9]', '', 'g') AS code, regexp_replace(code, '[^0-9]', '', 'g') LIKE '%5' AS restricted, regexp_replace(code, '[^0-9]', '', 'g') NOT LIKE '%7' AS active FROM f WHERE id % 5 <> 0) SELECT id, CASE WHEN r.code IS NULL THEN 'unknown' WHEN NOT active THEN 'inactive' WHEN restricted THEN 'restricted' ELSE 'ok' END AS status FROM f LEFT JOIN r ON regexp_replace(f.code, '[^0-9]', '', 'g') = r.code")
def c10(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, _CUSTOMS).withColumn("key", codes.digits_only(F.col("code")))
    known = f.filter("id % 5 <> 0").select("key", F.col("key").endswith("5").alias("restricted"), (~F.col("key").endswith("7")).alias("active"), F.lit(True).alias("known")).distinct()
    status = F.when(F.col("known").isNull(), "unknown").when(~F.col("active"), "inactive").when(F.col("restricted"), "restricted").otherwise("ok")
    return f.join(known, "key", "left").select("id", status.alias("status"))


@query("c20_code_sets", "WITH s AS (SELECT DISTINCT l_orderkey AS doc, l_linestatus AS side, l_partkey % 50 AS code FROM lineitem) SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.code, b.code) AS code, CASE WHEN b.code IS NULL THEN 'only in a' ELSE 'only in b' END AS verdict FROM (SELECT * FROM s WHERE side = 'F') a FULL JOIN (SELECT * FROM s WHERE side = 'O') b ON a.doc = b.doc AND a.code = b.code WHERE a.code IS NULL OR b.code IS NULL")
def c20(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50).alias("code")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b"))
    return sets.filter("a <> b").select("doc", "code", F.when(F.col("a"), "only in a").otherwise("only in b").alias("verdict"))


@query("t19_ean8_valid", _CODES + f"SELECT id, length(substring(b, 1, 7) || k) = 8 AND {_valid_sql("(substring(b, 1, 7) || k)")} AS valid FROM g")
def t19(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.ean8_valid(F.concat(F.substring("b", 1, 7), "k")).alias("valid"))


@query("t20_upc_as_ean13", _CODES + f"SELECT id, CASE WHEN length(d) = 12 AND {_valid_sql('d')} THEN '0' || d END AS ean FROM g")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.upc_as_ean13(F.col("code")).alias("ean"))


@query("t27_ean_checksum", _CODES + f"SELECT id, length(d) IN (8, 13, 14) AND {_valid_sql('d')} AS ok FROM g")
def t27(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).select("id", codes.ean_checksum_ok(F.col("code")).alias("ok"))
