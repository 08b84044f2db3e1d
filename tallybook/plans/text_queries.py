"""Queries over references, names, units, similarities and document text (T, M, F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, similarity, text
from .fixtures import REFS
from .registry import frame, plain, query, table

_REFS = f"WITH f AS ({plain(REFS)}) "


def loose_sql(s: str) -> str:
    return f"regexp_replace(upper(translate(coalesce({s}, ''), '‐‑‒–—−', '------')), '[\\s\\-_/]', '', 'g')"


def strict_sql(s: str) -> str:
    return f"regexp_replace(upper(coalesce({s}, '')), '[^A-Z0-9]', '', 'g')"


def _words_sql(s: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({s}, '')), '[^a-z0-9]+'), lambda w: length(w) > 2))"


def _jaccard_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


@query("t01_unicode_dashes", _REFS + "SELECT id, translate(replace(raw, '-', '–'), '‐‑‒–—−', '------') AS s FROM f")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, REFS).select("id", numbers.plain_dashes(F.replace("raw", F.lit("-"), F.lit("–"))).alias("s"))


@query("t02_loose_ref", _REFS + f"SELECT id, {loose_sql('raw')} AS ref FROM f")
def t02(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, REFS).select("id", text.loose_ref(F.col("raw")).alias("ref"))


@query("t03_strict_ref", _REFS + f"SELECT id, {strict_sql('raw')} AS ref FROM f")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, REFS).select("id", text.strict_ref(F.col("raw")).alias("ref"))


@query("t04_listed_ref", _REFS + "SELECT id, upper(trim(regexp_replace(regexp_replace(raw, '^\\s*[0-9]{1,3}\\.\\s+', ''), '\\s+', ' ', 'g'))) AS ref FROM f")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, REFS).select("id", text.listed_ref(F.col("raw")).alias("ref"))


@query("t05_company_name", """SELECT s_suppkey AS id, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(upper(concat(s_name, CASE s_suppkey % 4 WHEN 0 THEN ' Sp. z o.o.' WHEN 1 THEN ', S.A.' WHEN 2 THEN ' Limited' ELSE ' Co; KG' END)), '[.,;:\\-]', ' ', 'g'), '\\s+', ' ', 'g')),
  'SP Z O O', 'SPZOO'), 'SP ZO O', 'SPZOO'), 'S A', 'SA'), 'LIMITED', 'LTD'), 'CO KG', 'COKG') AS name FROM supplier""")
def t05(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    name = F.concat("s_name", F.when(k == 0, " Sp. z o.o.").when(k == 1, ", S.A.").when(k == 2, " Limited").otherwise(" Co; KG"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.company_name(name).alias("name"))


def _terms(k: Column) -> Column:
    return F.when(k % 4 == 0, "iw04").when(k % 4 == 1, "net 60 days").when(k % 4 == 2, "0001").otherwise("on delivery")


_TERMS = "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '30 days' WHEN 1 THEN '60 days' WHEN 2 THEN '14 days 2% / 30 days net' ELSE 'on delivery' END AS terms, CASE s_suppkey % 3 WHEN 0 THEN '30 days' WHEN 1 THEN '60 days' ELSE '14 days 2% / 30 days net' END AS other FROM supplier"


@query("t06_payment_terms", f"SELECT id, terms, terms = other AS same FROM ({_TERMS})")
def t06(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    other = F.when(k % 3 == 0, "IW04").when(k % 3 == 1, "60 Days net").otherwise("0001")
    terms = text.payment_terms(_terms(k))
    return table(spark, d, "supplier").select(k.alias("id"), terms.alias("terms"), (terms == text.payment_terms(other)).alias("same"))


@query("t08_payment_codes", f"SELECT id, CASE id % 4 WHEN 0 THEN 'IW04' WHEN 1 THEN 'IW07,N060,ZB60' WHEN 2 THEN '0001' ELSE '' END AS codes FROM ({_TERMS})")
def t08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(text.payment_codes(_terms(F.col("s_suppkey"))), ",").alias("codes"))


@query("t10_product_text", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat(p_name, '-', CAST(p_size AS VARCHAR), ' mm (x)')), '-', ' ', 'g'), '([0-9])\\s+(cm|mm|ml|g|fr|ga)\\b', '\\1\\2', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM part")
def t10(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"), F.lit(" mm (x)"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.product_text(s).alias("s"))


@query("t14_canonical_unit", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'PCS' WHEN 1 THEN 'CTN' WHEN 2 THEN 'CTN' WHEN 3 THEN 'OP' WHEN 4 THEN 'DRUM' ELSE '' END AS unit FROM part")
def t14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "szt.").when(k == 1, "Cartons").when(k == 2, "kartony").when(k == 3, "op").when(k == 4, "drum")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.canonical_unit(raw).alias("unit"))


@query("t31_delivery_number", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('45', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) WHEN o_orderkey % 3 = 1 THEN concat('45', lpad(CAST(o_custkey AS VARCHAR), 10, '0')) ELSE '' END AS number FROM orders")
def t31(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("dlv 45"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("/A"))).otherwise("no 123")
    second = F.when(F.col("o_orderkey") % 3 != 2, F.concat(F.lit("x45"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.delivery_number(first, second).alias("number"))


@query("t32_currency", "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'PLN' WHEN 3 THEN 'CNY' WHEN 4 THEN 'GBP' ELSE 'UNKNOW' END AS iso FROM supplier")
def t32(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    raw = F.when(k == 0, "U.S. Dollars").when(k == 1, " euro").when(k == 2, "zloty").when(k == 3, "rmb").when(k == 4, "Pounds").otherwise("unknown")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.currency(raw).alias("iso"))


@query("t34_payment_severity", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 2 AND s_suppkey % 3 = 2 THEN 'warning' WHEN s_suppkey % 4 = 2 OR s_suppkey % 3 = 2 THEN 'error' WHEN s_suppkey % 4 = 0 AND s_suppkey % 3 = 1 THEN 'error' ELSE 'warning' END AS severity FROM supplier")
def t34(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = F.when(k % 4 == 0, "IW04").when(k % 4 == 1, "net 60 days").when(k % 4 == 2, "in advance").otherwise("on delivery")
    other = F.when(k % 3 == 0, "45 DAYS").when(k % 3 == 1, "90 DAYS").otherwise("PREPAYMENT")
    return table(spark, d, "supplier").select(k.alias("id"), text.payment_severity(text.payment_terms(own), other).alias("severity"))


@query("t36_line_sections", """SELECT section, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, CASE WHEN regexp_matches(line, '(?i)licen[cs]e|copyright') THEN 'legal' WHEN regexp_matches(line, '@|https?://') THEN 'contact' WHEN regexp_matches(line, '[0-9]{3}') THEN 'numbers' WHEN length(line) < 30 THEN 'title' ELSE 'text' END AS section
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '') GROUP BY section""")
def t36(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).filter("line <> ''")
    line = F.col("line")
    section = F.when(line.rlike("(?i)licen[cs]e|copyright"), "legal").when(line.rlike("@|https?://"), "contact").when(line.rlike("[0-9]{3}"), "numbers").when(F.length(line) < 30, "title").otherwise("text")
    return lines.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query("t38_dimensions", "SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 5 AND 2000 THEN CAST(p_size AS DOUBLE) END AS w, CASE WHEN p_size BETWEEN 5 AND 2000 THEN CAST(p_size + 10 AS DOUBLE) + 0.5 END AS h FROM part")
def t38(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    s = F.concat(F.lit("box 1x2x3 mm, "), size, F.lit(" × "), (F.col("p_size") + 10).cast("string"), F.lit(",5 x 300 mm"))
    found = text.dimensions(s)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(found, F.lit(0)).cast("double").alias("w"), F.get(found, F.lit(1)).cast("double").alias("h"))


@query("t40_keyword_list", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '|', p_type) ELSE p_brand END AS words FROM part")
def t40(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" ;, "), "p_type", F.lit(";"))).otherwise(F.concat("p_brand", F.lit(",")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.keyword_list(raw), "|").alias("words"))


@query("t41_container_number", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('MSKU', lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0')) END AS container FROM orders")
def t41(spark: SparkSession, d: str) -> DataFrame:
    number = F.lpad((F.col("o_orderkey") % 10_000_000).cast("string"), 7, "0")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("cntr msku"), number, F.lit(" 40HC"))).otherwise(F.concat(F.lit("MSK"), number))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.container_number(raw).alias("container"))


@query("t43_first_pattern", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '([0-9]{4})', 1), ''), nullif(regexp_extract(text, '([A-Z][a-z]{5,})', 1), '')) AS found FROM documents")
def t43(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_match(F.col("text"), ["([0-9]{4})", "([A-Z][a-z]{5,})"]).alias("found"))


@query("t47_references_in_text", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[a-z]{3}[0-9]{2,}|[0-9]{4,}'))) AS n_refs FROM documents")
def t47(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{3}[0-9]{2,}|[0-9]{4,})"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_refs"))


@query("t48_cell_lines", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' ') AS cell FROM documents")
def t48(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(lines, 1, 3), " ").alias("cell"))


@query("t50_file_roles", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'supplier' ELSE 'unknown' END AS role, concat('ab', CAST(p_partkey AS VARCHAR)) AS name FROM part")
def t50(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("AB"), k.cast("string"), F.when(k % 3 == 0, "_MASTER").when(k % 3 == 1, "-proof").otherwise(""), F.lit(".pdf"))
    return table(spark, d, "part").select(k.alias("id"), text.role_of_name(name).alias("role"), text.without_role(name).alias("name"))


@query("f01_literal_like", "SELECT p_partkey AS id, replace(replace(replace(concat(p_name, '%_', chr(92)), chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') AS pattern FROM part")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.literal_like(F.concat("p_name", F.lit("%_\\"))).alias("pattern"))


@query("f02_search_suppliers", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 AND (contains(lower(s_name), '1') OR contains(CAST(s_suppkey AS VARCHAR), '2')) ORDER BY s_name LIMIT 300")
def f02(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_acctbal > 0")
    return s.filter(F.lower("s_name").contains("1") | F.col("s_suppkey").cast("string").contains("2")).select("s_suppkey", "s_name").orderBy("s_name").limit(300)


@query("f05_supplier_of_producer", "SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) AS r FROM part JOIN supplier ON upper(concat('n', CAST(p_size AS VARCHAR))) = upper(concat('N', CAST(s_nationkey AS VARCHAR))) WHERE s_acctbal > 0) WHERE r = 1")
def f05(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.upper(F.concat(F.lit("n"), F.col("p_size").cast("string"))).alias("code"))
    first = table(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.upper(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("code")).agg(F.min("s_suppkey").alias("s_suppkey"))
    return parts.join(first, "code").select("p_partkey", "s_suppkey")


_KINDS = {"invoice": ("invoice|the", "of"), "packing": ("in", "and"), "customs": ("as", "is", "xyz")}


@query("f06_document_type", "SELECT doc_id, kind, score FROM (SELECT doc_id, kind, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM (SELECT doc_id, " + "unnest(['invoice','packing','customs']) AS kind, unnest([1,2,3]) AS place, unnest([(CAST(regexp_matches(text, 'invoice|the') AS INT) + CAST(regexp_matches(text, 'of') AS INT)) / 2.0, (CAST(regexp_matches(text, 'in') AS INT) + CAST(regexp_matches(text, 'and') AS INT)) / 2.0, (CAST(regexp_matches(text, 'as') AS INT) + CAST(regexp_matches(text, 'is') AS INT) + CAST(regexp_matches(text, 'xyz') AS INT)) / 3.0]) AS score FROM documents)) WHERE r = 1", money=("score",))
def f06(spark: SparkSession, d: str) -> DataFrame:
    share = lambda ps: sum(F.col("text").rlike(p).cast("int") for p in ps) / F.lit(float(len(ps)))
    best = F.array_max(F.array(*(F.struct(share(ps).alias("score"), F.lit(-k).alias("order"), F.lit(kind).alias("kind")) for k, (kind, ps) in enumerate(_KINDS.items()))))
    return table(spark, d, "documents").select("doc_id", best.alias("best")).select("doc_id", F.col("best.kind").alias("kind"), F.col("best.score").alias("score"))


@query("f11_ref_shape", _REFS + "SELECT id, length(trim(raw)) BETWEEN 2 AND 60 AND regexp_matches(trim(raw), '^[A-Za-z0-9][A-Za-z0-9 ._/-]*$') AND regexp_matches(raw, '[0-9]') AND upper(trim(raw)) NOT IN ('TOTAL', 'SUM', 'REF') AS valid FROM f")
def f11(spark: SparkSession, d: str) -> DataFrame:
    raw = F.trim("raw")
    valid = F.length(raw).between(2, 60) & raw.rlike("^[A-Za-z0-9][A-Za-z0-9 ._/-]*$") & raw.rlike("[0-9]") & ~F.upper(raw).isin("TOTAL", "SUM", "REF")
    return frame(spark, d, REFS).select("id", valid.alias("valid"))


@query("m02_refs_match", _REFS + f", n AS (SELECT id, {loose_sql('raw')} AS a, {loose_sql('other')} AS b, raw, other FROM f) SELECT id, CASE WHEN coalesce(raw, '') = '' OR coalesce(other, '') = '' THEN 'missing' WHEN a = b THEN 'same' WHEN replace(a, '0', '') = replace(b, '0', '') THEN 'zeros' WHEN regexp_matches(a, '[0-9]$') AND regexp_matches(b, '[0-9]$') AND regexp_replace(a, '[0-9]+$', '') = regexp_replace(b, '[0-9]+$', '') THEN 'size' ELSE 'open' END AS verdict FROM n")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, REFS).select("id", similarity.ref_verdict(F.col("raw"), F.col("other")).alias("verdict"))


@query("m03_scan_errors", _REFS + "SELECT id, upper(concat('AB', lpad(CAST(id AS VARCHAR), 5, '0'), 'S')) <> upper(other) AND translate(upper(concat('AB', lpad(CAST(id AS VARCHAR), 5, '0'), 'S')), 'IO', '10') = translate(upper(other), 'IO', '10') AS confused FROM f")
def m03(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("AB"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("S"))
    return frame(spark, d, REFS).select("id", ((F.upper(own) != F.upper("other")) & (text.scan_key(own) == text.scan_key(F.col("other")))).alias("confused"))


@query("m05_long_repeats", "SELECT doc_id, len(regexp_extract_all(text, 'a{3,}|b{3,}|c{3,}|d{3,}|e{3,}|f{3,}|g{3,}|h{3,}|i{3,}|j{3,}|k{3,}|l{3,}|m{3,}|n{3,}|o{3,}|p{3,}|q{3,}|r{3,}|s{3,}|t{3,}|u{3,}|v{3,}|w{3,}|x{3,}|y{3,}|z{3,}|ß{3,}|é{3,}|è{3,}|ä{3,}|ö{3,}|ü{3,}|ñ{3,}|ó{3,}|í{3,}|ç{3,}|ê{3,}|á{3,}')) AS n FROM documents")
def m05(spark: SparkSession, d: str) -> DataFrame:
    lower = F.array_join(F.regexp_extract_all("text", F.lit("([a-zßéèäöüñóíçêá]+)"), F.lit(1)), " ")
    return table(spark, d, "documents").select("doc_id", F.size(text.long_repeats(lower)).cast("long").alias("n"))


@query("m08_confusable_tokens", "WITH t AS (SELECT DISTINCT l_returnflag AS side, concat('AB', CASE WHEN l_returnflag = 'N' THEN replace(lpad(CAST(l_partkey AS VARCHAR), 7, '0'), '1', 'I') ELSE lpad(CAST(l_partkey AS VARCHAR), 7, '0') END) AS token FROM lineitem WHERE l_returnflag IN ('N', 'R')) SELECT a.token AS token_a, b.token AS token_b FROM t a JOIN t b ON translate(a.token, 'IO', '10') = translate(b.token, 'IO', '10') AND a.token <> b.token WHERE a.side = 'N' AND b.side = 'R'")
def m08(spark: SparkSession, d: str) -> DataFrame:
    padded = F.lpad(F.col("l_partkey").cast("string"), 7, "0")
    token = F.concat(F.lit("AB"), F.when(F.col("l_returnflag") == "N", F.translate(padded, "1", "I")).otherwise(padded))
    tokens = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("N", "R")).select("l_returnflag", token.alias("token")).distinct().withColumn("key", text.scan_key(F.col("token")))
    a, b = tokens.filter("l_returnflag = 'N'").select("key", F.col("token").alias("token_a")), tokens.filter("l_returnflag = 'R'").select("key", F.col("token").alias("token_b"))
    return a.join(b, "key").filter("token_a <> token_b").select("token_a", "token_b")


@query("m10_best_match", "WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings) SELECT q AS vec_id, c AS match_id FROM (SELECT a.vec_id AS q, b.vec_id AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (a.len * b.len), 9) DESC, b.vec_id) AS r FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE r = 1")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return similarity.best_matches(table(spark, d, "embeddings").filter("vec_id % 50 = 0"), table(spark, d, "embeddings"))


#: Words of all items that may go to every task.
INDEX_WORDS = 200_000


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, doc_id, shared, overlap): all items and documents that share a word, by an index of the items' words.

    The index goes to the documents where its size allows it, so that none of their words is shuffled and tasks count first.
    """
    items = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("a"))
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("b"))
    left, right = items.select("item_id", F.size("a").alias("na"), F.explode("a").alias("w")), docs.select("doc_id", F.size("b").alias("nb"), F.explode("b").alias("w"))
    few = items.agg(F.sum(F.size("a"))).first()[0] or 0
    shared = right.join(F.broadcast(left) if few <= INDEX_WORDS else left, "w").groupBy("item_id", "doc_id", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("item_id", "doc_id", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 9).alias("overlap"))


OVERLAPS = f"""WITH i AS (SELECT item_id, {_words_sql('text')} AS a FROM benchmark), d AS (SELECT doc_id, {_words_sql('text')} AS b FROM documents), o AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS shared, round({_jaccard_sql('a', 'b')}, 9) AS overlap FROM i, d) """


@query("m11_jaccard", OVERLAPS + "SELECT item_id, doc_id, overlap FROM o WHERE shared > 0")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(spark, d).select("item_id", "doc_id", "overlap")


@query("m13_prefix_score", f"SELECT p.p_partkey, s.s_suppkey, round(coalesce(len(list_intersect({_words_sql('p.p_name')}, {_words_sql('s.s_name')})) / nullif(greatest(len({_words_sql('p.p_name')}), len({_words_sql('s.s_name')})), 0), 0.0), 9) AS score FROM part p JOIN supplier s ON p.p_partkey % 100 = s.s_suppkey")
def m13(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("s_suppkey"), text.tokens(F.col("p_name")).alias("a"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", text.tokens(F.col("s_name")).alias("b"))
    return parts.join(suppliers, "s_suppkey").select("p_partkey", "s_suppkey", F.round(text.shared_of_larger(F.col("a"), F.col("b")), 9).alias("score"))


@query("m01_token_sort_ratio")
def m01(spark: SparkSession, d: str) -> DataFrame:
    pairs = frame(spark, d, REFS).filter("raw is not null")
    return pairs.select("id", similarity.token_sort_ratio("raw", "other").alias("ratio"))


@query("m16_line_diff")
def m16(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    w = Window.partitionBy("lang", (F.col("doc_id") / 100).cast("long")).orderBy("doc_id")
    pairs = docs.select("doc_id", "text", F.lag("text").over(w).alias("before")).filter("before is not null")
    return similarity.line_changes(pairs, "before", "text", "doc_id")
