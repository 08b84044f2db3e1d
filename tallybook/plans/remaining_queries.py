"""Queries of the inventory's smaller entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import codes, similarity, text
from ..operators import compare, linkage, timing
from .compare_queries import _MATCHED, _compared
from .fixtures import CODES, REFS
from .registry import frame, plain, query, table


@query("s04_first_method_only", "SELECT user_id, event_id FROM (SELECT *, min(p) OVER (PARTITION BY user_id) AS best FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS p FROM events)) WHERE p = best")
def s04(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    e = table(spark, d, "events").select("user_id", "event_id", p.alias("p"))
    best = e.groupBy("user_id").agg(F.min("p").alias("p"))
    return e.join(best, ["user_id", "p"], "left_semi").select("user_id", "event_id")


@query("s12_listing", "SELECT p_partkey AS id, concat('/art/', p_brand, '/', CAST(p_partkey AS VARCHAR), '.pdf') AS rel_path FROM part WHERE p_partkey % 3 = 0")
def s12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("\\art\\"), "p_brand", F.lit("\\"), k.cast("string"), F.when(k % 3 == 0, ".PDF").otherwise(".tif"))
    entries = table(spark, d, "part").select(k.alias("id"), F.translate(path, "\\", "/").alias("p")).filter(F.lower("p").endswith(".pdf"))
    return entries.select("id", F.regexp_replace("p", "(?i)[.]pdf$", ".pdf").alias("rel_path"))


@query("s14_material_rules", "SELECT concat('AB', CAST(p_partkey AS VARCHAR)) AS ref, lvl AS unit_from, 'PCS' AS unit_to, CAST(f AS DOUBLE) AS factor FROM (SELECT p_partkey, unnest(['OP', 'CTN']) AS lvl, unnest([p_size, p_size * 10]) AS f FROM part) WHERE f > 1")
def s14(spark: SparkSession, d: str) -> DataFrame:
    levels = F.array(F.struct(F.lit("OP").alias("unit"), F.col("p_size").alias("n")), F.struct(F.lit("CTN").alias("unit"), (F.col("p_size") * 10).alias("n")))
    rows = table(spark, d, "part").select(F.concat(F.lit("AB"), F.col("p_partkey").cast("string")).alias("ref"), F.explode(levels).alias("l")).filter("l.n > 1")
    return rows.select("ref", F.col("l.unit").alias("unit_from"), F.lit("PCS").alias("unit_to"), F.col("l.n").cast("double").alias("factor"))


@query("s17_stock_by_reference", "SELECT norm, qty FROM (SELECT regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS norm, p_size AS qty, row_number() OVER (PARTITION BY regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1")
def s17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(text.strict_ref(F.col("p_brand")).alias("norm"), "p_partkey", F.col("p_size").alias("qty"))
    old = spark.createDataFrame([], "norm string, qty int")
    return sources.upsert(old, rows, ["norm"], ["p_partkey"])


@query("s18_absorbed_products", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE coalesce(s_name, '') END AS name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def s18(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name")
    joined = table(spark, d, "part").join(suppliers, F.col("p_partkey") == F.col("s_suppkey"), "left")
    return joined.select("p_partkey", F.coalesce(compare.keep_known(own, F.col("s_name")), F.lit("")).alias("name"))


@query("f03_wildcard_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%l_e bol%' ORDER BY p_partkey LIMIT 200")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_name").ilike("%l_e bol%")).select("p_partkey", "p_name").orderBy("p_partkey").limit(200)


@query("f08_first_rule", "SELECT lang, kind, count(*) AS n FROM (SELECT lang, CASE WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'licence' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' WHEN regexp_matches(text, '^The') THEN 'text' ELSE 'other' END AS kind FROM documents) GROUP BY 1, 2")
def f08(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    kind = F.when(F.lower(t).rlike("licen[cs]e"), "licence").when(t.rlike("[0-9]{4}"), "numbers").when(t.rlike("^The"), "text").otherwise("other")
    return table(spark, d, "documents").groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("f09_type_of_file_name", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'PO' WHEN 1 THEN 'CI' WHEN 2 THEN 'PL' END AS kind FROM part")
def f09(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 4 == 0, "PO_").when(k % 4 == 1, "x-CI-").when(k % 4 == 2, "a PL.").otherwise("POX"), k.cast("string"), F.lit(".pdf"))
    found = F.regexp_extract(F.upper(name), r"(?:^|[^A-Z0-9])(PO|PI|CI|PL|BL|SAD)(?:[^A-Z]|$)", 1)
    return table(spark, d, "part").select(k.alias("id"), F.nullif(found, F.lit("")).alias("kind"))


@query("f12_ref_value", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE o_orderkey < 100000000 END AS is_ref FROM orders")
def f12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("45"), F.lpad(k.cast("string"), 8, "0"))).when(k % 3 == 1, F.concat(F.lit("AB-"), k.cast("string"))).otherwise(k.cast("string"))
    is_ref = raw.rlike("^[A-Za-z0-9][A-Za-z0-9._/ -]*$") & raw.rlike("[0-9]") & ~raw.rlike("^45[0-9]{8}$") & ~raw.rlike("^[0-9]{9,}$")
    return table(spark, d, "orders").select(k.alias("id"), is_ref.alias("is_ref"))


@query("f14_subtotal_rows", "SELECT p_partkey AS id, p_partkey % 4 = 0 AS subtotal, p_partkey % 4 IN (1, 0) AND p_partkey % 4 <> 0 AS total FROM part")
def f14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    cells = F.array(F.when(k == 0, "Sub-Total").when(k == 1, "GRAND TOTAL").when(k == 2, "Totally new product of the year").otherwise("item"), F.col("p_size").cast("string"))
    joined = F.lower(F.array_join(cells, " "))
    subtotal = joined.rlike("sub[ -]?total|suma cz[eę][sś]ciowa|podsuma")
    label = F.exists(cells, lambda c: (F.length(c) <= 25) & F.lower(F.trim(c)).rlike(r"^(grand\s+total|total\s+amount|total|razem|suma)\b"))
    total = joined.rlike("total ?:|razem:|suma:|grand total") | label
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), subtotal.alias("subtotal"), (total & ~subtotal).alias("total"))


@query("f19_required_for_status", "SELECT o_orderkey, 'R' AS missing FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def f19(spark: SparkSession, d: str) -> DataFrame:
    required = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("R").alias("missing"))
    present = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("missing"))
    return required.join(present, ["o_orderkey", "missing"], "left_anti")


@query("d08_recent_rows", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 36 HOUR")
def d08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("ts > timestamp_ntz '2024-01-30' - interval 36 hours").select("event_id")


@query("t07_terms_equal", "SELECT s_suppkey AS id, s_suppkey % 3 IN (0, 1) AS same FROM supplier")
def t07(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    other = F.when(k == 0, "30 DAYS").when(k == 1, "zb30").otherwise("IW07")
    same = F.lower(text.payment_terms(F.lit("IW04"))) == F.lower(text.payment_terms(other))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), same.alias("same"))


@query("t22_gtin_of_any_length", f"WITH f AS ({plain(CODES)}), g AS (SELECT id, b || k AS full13, '1' || b AS body14 FROM f) SELECT id, true AS ean13, length(full13) = 13 AS long FROM g")
def t22(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat("b", "k")
    return frame(spark, d, CODES).select("id", codes.gtin_valid(full).alias("ean13"), codes.gtin_valid(F.concat(F.lit("1"), "b", codes.check_digit(F.concat(F.lit("1"), "b")).cast("string"))).alias("long"))


@query("t24_missing_identifiers", f"WITH f AS ({plain(CODES)}) SELECT id, CASE WHEN id % 2 = 0 THEN '17,10' ELSE '10' END AS missing FROM f")
def t24(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("(01)"), "b", "k", F.when(F.col("id") % 2 == 1, "(17)250101").otherwise(""))
    return frame(spark, d, CODES).select("id", F.array_join(codes.gs1_missing(codes.gs1_bracketed(raw)), ",").alias("missing"))


@query("t29_revision_order", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 10 DESC, lang DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def t29(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct((F.col("n_chars") % 10).alias("rank"), "lang", "doc_id")
    return table(spark, d, "documents").groupBy("source").agg(F.max(key).alias("m")).select("source", F.col("m.doc_id").alias("doc_id"))


@query("t33_code_phrases", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN '30 days' WHEN 1 THEN '90 days net' ELSE '' END AS phrase FROM supplier")
def t33(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    code = F.when(k == 0, "N030").when(k == 1, "NT90").otherwise("X")
    names = F.create_map(*(F.lit(x) for p in text.PAYMENT_CODES.items() for x in p))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(F.try_element_at(names, code), F.lit("")).alias("phrase"))


@query("t49_json_in_text", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def t49(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Here it is: "), "props", F.lit(" - done."))
    found = F.regexp_extract(said, r"(\{[^{}]*\})", 1)
    return table(spark, d, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("j29_profile_with_defaults", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, 'default') AS profile FROM part")
def j29(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    by_code = part.filter("p_size % 2 = 0").select("p_partkey", F.col("p_brand").alias("one"))
    by_ref = part.filter("p_size % 3 = 0").select("p_partkey", F.col("p_type").alias("two"))
    return part.select("p_partkey").join(by_code, "p_partkey", "left").join(by_ref, "p_partkey", "left").select("p_partkey", F.coalesce("one", "two", F.lit("default")).alias("profile"))


@query("j34_latest_document", "SELECT o_custkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def j34(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1"))
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("j32_signature_lookup", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON md5(CAST(c.c_custkey AS VARCHAR)) = md5(CAST(s.s_suppkey AS VARCHAR))")
def j32(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("sig"))
    b = table(spark, d, "supplier").select("s_suppkey", F.md5(F.col("s_suppkey").cast("string")).alias("sig"))
    return a.join(b, "sig").select("c_custkey", "s_suppkey")


@query("c03_compare_field")
def c03(spark: SparkSession, d: str) -> DataFrame:
    """Texts by their ratio: over 92 the same notation, over 70 doubtful, else different."""
    pairs = frame(spark, d, REFS).withColumn("ratio", similarity.token_sort_ratio("raw", "other"))
    r = F.col("ratio")
    return pairs.select("id", F.when(r.isNull(), "missing").when(r == 100, "ok").when(r >= 92, "format").when(r >= 70, "doubtful").otherwise("different").alias("status"), "ratio")


@query("c06_totals_first", "WITH s AS (SELECT l_orderkey AS doc, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1) SELECT doc, CASE WHEN abs(total - CAST(o_totalprice AS DECIMAL(18,2))) <= 1 THEN 'ok' WHEN abs(total - CAST(o_totalprice AS DECIMAL(18,2))) * 50 <= total THEN 'doubtful' ELSE 'different' END AS total_status FROM s JOIN orders ON doc = o_orderkey")
def c06(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    gap = F.abs(F.col("total") - F.col("o_totalprice").cast("decimal(18,2)"))
    return sums.join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("doc") == F.col("o_orderkey")).select("doc", F.when(gap <= 1, "ok").when(gap * 50 <= F.col("total"), "doubtful").otherwise("different").alias("total_status"))


@query("c11_findings_of_audit", _MATCHED + "SELECT doc, 'customs' AS category, CASE status WHEN 'different' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM c WHERE status IN ('different', 'doubtful') GROUP BY 1, 2, 3")
def c11(spark: SparkSession, d: str) -> DataFrame:
    audit = _compared(spark, d).filter(F.col("status").isin("different", "doubtful"))
    return audit.groupBy("doc", F.lit("customs").alias("category"), F.when(F.col("status") == "different", "error").otherwise("warning").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("c22_printed_data", f"WITH f AS ({plain(CODES)}) SELECT id, id % 6 IN (0, 1) AS ean_ok, id % 4 <> 3 AS lot_ok FROM f")
def c22(spark: SparkSession, d: str) -> DataFrame:
    encoded = codes.gs1_bracketed(F.concat(F.lit("(01)"), "b", "k", F.lit("(10)L"), F.col("id").cast("string")))
    printed = F.concat(F.lit("L"), F.when(F.col("id") % 4 == 3, (F.col("id") + 1).cast("string")).otherwise(F.col("id").cast("string")))
    rows = frame(spark, d, CODES).withColumn("ai", encoded)
    return rows.select("id", (codes.digits_only(F.col("code")) == F.try_element_at("ai", F.lit("01"))).alias("ean_ok"), (printed == F.try_element_at("ai", F.lit("10"))).alias("lot_ok"))


@query("a08_jobs_of_suppliers", "SELECT l_suppkey, count(*) AS n, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last"))


@query("a14_third_roll_up", _MATCHED + "SELECT doc, count(*) FILTER (WHERE status <> 'ok') AS n_open, count(*) AS n FROM c GROUP BY doc")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).groupBy("doc").agg(F.count_if(F.col("status") != "ok").alias("n_open"), F.count(F.lit(1)).alias("n"))


@query("a23_milestones", "SELECT user_id, min(CAST(ts AS DATE)) FILTER (WHERE value > 90) AS discharged, min(CAST(ts AS DATE)) FILTER (WHERE value BETWEEN 50 AND 90) AS gate_out, min(CAST(ts AS DATE)) FILTER (WHERE value < 5) AS returned FROM events GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.min(F.when(c, F.col("ts").cast("date")))
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(first(v > 90).alias("discharged"), first(v.between(50, 90)).alias("gate_out"), first(v < 5).alias("returned"))


@query("w08_next_and_previous", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'packing_list_otrzymany' WHEN 1 THEN 'wyslane_do_dostawcy' END AS next FROM supplier")
def w08(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    status = F.when(k == 0, "na_miejscu").when(k == 1, "utworzone").otherwise("rozliczone")
    return table(spark, d, "supplier").select("s_suppkey", timing.next_step(status).alias("next"))


@query("w18_column_to_best_role", "SELECT l_orderkey AS doc, l_linenumber AS col, max_by(l_returnflag, struct_pack(n := n, f := l_returnflag)) AS role FROM (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) * CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def w18(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("col"), "l_returnflag").agg((F.count(F.lit(1)) * F.when(F.col("l_returnflag") == "R", 2).otherwise(1)).alias("n"))
    return counts.groupBy("doc", "col").agg(F.max(F.struct("n", "l_returnflag")).alias("m")).select("doc", "col", F.col("m.l_returnflag").alias("role"))


@query("j16_greedy_lines")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """Lines of neighbouring short documents paired one to one, best first, from a ratio of 70 on."""
    lines = table(spark, d, "documents").filter("n_chars < 3000").select(F.expr("doc_id div 2").alias("g"), (F.col("doc_id") % 2).alias("side"), F.explode(F.split("text", "\n")).alias("line")).filter("length(line) between 4 and 200").distinct()
    a, b = lines.filter("side = 0").select("g", "line"), lines.filter("side = 1").select("g", "line")
    pairs = linkage.greedy_pairs(linkage.candidates_by_trigram(a, b, "g", "line", 70.0), "g", "a", "b", "score")
    return pairs.withColumn("verdict", F.when(F.col("score") >= 95, "equal").otherwise("changed"))


@query("k11_delivery_queue", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, c_name, count(l_linenumber) AS n_lines FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' GROUP BY 1, 2, 3")
def k11(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = orders.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(counts, "o_orderkey", "left")
    return joined.select("o_orderkey", "day", "c_name", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("w23_rare_words", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) > 2) WHERE w IN (SELECT w FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) > 2) GROUP BY w HAVING count(*) = 1) GROUP BY doc_id")
def w23(spark: SparkSession, d: str) -> DataFrame:
    """Words that one document alone has: those that weigh most by inverse frequency."""
    words = table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    alone = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    return alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("a20_first_of_near_boxes", "SELECT g, min(b) AS b, count(*) AS n FROM (SELECT s_nationkey AS g, CAST(floor(s_acctbal / 100) AS BIGINT) AS b FROM supplier) GROUP BY g, b")
def a20(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.floor(F.col("s_acctbal") / 100).alias("b"))
    return boxes.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))


@query("w21_batch_rows_in_order", "SELECT o_custkey AS batch, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS place FROM orders")
def w21(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", F.row_number().over(w).alias("place"))


@query("f15_total_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE regexp_matches(line, '(^|[^a-z0-9_-])(total|the)($|[^a-z0-9_-])') GROUP BY doc_id")
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a total's word standing alone, not as part of a hyphened one."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.lower("line").rlike(r"(?<![a-z0-9_-])(total|the)(?![a-z0-9_-])")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("s16_suppliers_keep_known", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'renamed ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 3 <> 2 THEN s_nationkey + 1 ELSE s_nationkey END AS nation FROM supplier UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 5 = 0")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """New rows over old suppliers, in which a blank or missing value erases nothing, and new suppliers."""
    old = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    k = F.col("s_suppkey")
    sent = old.filter(k % 3 != 2).select("s_suppkey", F.lit(1).alias("at"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("renamed "), "name")).alias("name"), F.when(k % 2 == 1, F.col("nation") + 1).alias("nation"))
    fresh = old.filter(k % 5 == 0).select((-1 - k).alias("s_suppkey"), F.lit(1).alias("at"), "name", "nation")
    return sources.upsert(old, sent.union(fresh), ["s_suppkey"], ["at"], keep_blank=["name", "nation"])

