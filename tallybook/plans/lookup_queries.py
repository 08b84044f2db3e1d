"""Queries of lookups, gates and pairings that complete the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, similarity, text
from ..operators import linkage, products
from .fixtures import AMOUNTS, CODES, ITEMS_A, ITEMS_B, REFS
from .number_queries import number_sql
from .registry import frame, plain, query, table


@query("n09_scientific_first", f"WITH f AS ({plain(AMOUNTS)}), c AS (SELECT id, regexp_replace(concat(b, ' kg'), '[A-Za-z\\s]+', '', 'g') AS t FROM f) SELECT id, CAST(round({number_sql('t')}, 6) AS DECIMAL(28,6)) AS v FROM c", money=("v",))
def n09(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, AMOUNTS).select("id", numbers.parse_amount(F.concat("b", F.lit(" kg")), 6).cast("decimal(28,6)").alias("v"))


@query("t13_single_pass_replace", "SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(p_type, 'ECONOMY', '<1>', 'g'), 'SMALL', '<2>', 'g'), 'LARGE', '<3>', 'g') AS s FROM part")
def t13(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_type")
    for k, word in enumerate(("ECONOMY", "SMALL", "LARGE")):
        s = F.replace(s, F.lit(word), F.lit(f"<{k + 1}>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))


@query("t35_first_lot", f"WITH f AS ({plain(REFS)}) SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) WHEN id % 3 = 0 THEN 'B' || CAST(id AS VARCHAR) ELSE '-' END AS lot FROM f")
def t35(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("string")
    s = F.when(F.col("id") % 2 == 0, F.concat(F.lit("LOT: "), k)).when(F.col("id") % 3 == 0, F.concat(F.lit("batch B"), k)).otherwise("none")
    return frame(spark, d, REFS).select("id", F.coalesce(text.first_match(s, [r"(?i)lot[:\s]+([A-Z0-9]+)", r"(?i)batch\s+([A-Z0-9]+)"]), F.lit("-")).alias("lot"))


@query("t39_package_type", "SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'bolt') THEN 'box' WHEN contains(lower(p_name), 'ring') THEN 'pouch' WHEN contains(lower(p_type), 'economy') THEN 'tin' ELSE 'unknown' END AS kind FROM part")
def t39(spark: SparkSession, d: str) -> DataFrame:
    n, t = F.lower("p_name"), F.lower("p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(n.contains("bolt"), "box").when(n.contains("ring"), "pouch").when(t.contains("economy"), "tin").otherwise("unknown").alias("kind"))


@query("t42_invoice_number", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'A' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN 'B' || CAST(o_custkey AS VARCHAR) ELSE '' END AS number FROM orders")
def t42(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = F.create_map(F.lit("invoice_no"), F.when(k % 3 == 0, F.concat(F.lit("A"), k.cast("string"))).otherwise(" "), F.lit("number"), F.when(k % 3 == 1, F.concat(F.lit("B"), F.col("o_custkey").cast("string"))))
    first = F.coalesce(*(F.nullif(F.trim(F.try_element_at(fields, F.lit(n))), F.lit("")) for n in ("invoice_no", "number", "doc_no")), F.lit(""))
    return table(spark, d, "orders").select(k.alias("id"), first.alias("number"))


@query("m06_missing_references", f"WITH a AS ({plain(ITEMS_A)}), b AS ({plain(ITEMS_B)}) SELECT a.doc, a.ref, CASE WHEN x.ref IS NOT NULL THEN 'typo' ELSE 'missing' END AS verdict FROM a LEFT JOIN b ON a.doc = b.doc AND a.ref = b.ref LEFT JOIN b x ON a.doc = x.doc AND x.ref = a.ref || 'X' WHERE b.ref IS NULL")
def m06(spark: SparkSession, d: str) -> DataFrame:
    a, b = frame(spark, d, ITEMS_A).select("doc", "ref"), frame(spark, d, ITEMS_B).select("doc", "ref")
    absent = a.join(b, ["doc", "ref"], "left_anti")
    near = b.withColumn("ref", F.regexp_replace("ref", "X$", "")).filter("length(ref) > 0").join(a, ["doc", "ref"], "left_semi").select("doc", "ref", F.lit(True).alias("near")).distinct()
    return absent.join(near, ["doc", "ref"], "left").select("doc", "ref", F.when(F.col("near"), "typo").otherwise("missing").alias("verdict"))


@query("m07_compare_text_fields", f"WITH f AS ({plain(REFS)}) SELECT id, CASE WHEN coalesce(raw, '') = '' THEN 'missing' WHEN raw = other THEN 'same' WHEN upper(replace(translate(raw, '-_/ ', '____'), '_', '')) = upper(other) THEN 'format' WHEN translate(upper(replace(translate(raw, '-_/ ', '____'), '_', '')), 'IO', '10') = translate(upper(other), 'IO', '10') THEN 'swap' ELSE 'different' END AS verdict FROM f")
def m07(spark: SparkSession, d: str) -> DataFrame:
    raw, other = text.loose_ref(F.col("raw")), F.upper("other")
    verdict = F.when(F.coalesce("raw", F.lit("")) == "", "missing").when(F.col("raw") == F.col("other"), "same").when(raw == other, "format").when(text.scan_key(raw) == text.scan_key(other), "swap").otherwise("different")
    return frame(spark, d, REFS).select("id", verdict.alias("verdict"))


@query("m15_changed_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) SELECT a.doc_id, CAST(len(list_filter(range(1, least(len(a.lines), len(b.lines)) + 1), lambda i: a.lines[i] <> b.lines[i])) + abs(len(a.lines) - len(b.lines)) AS BIGINT) AS n FROM l a JOIN l b ON b.doc_id = a.doc_id + 1")
def m15(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("a"))
    after = lines.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    # Lines beyond the shorter text count as changed, like lines that differ.
    changed = F.filter(F.zip_with("a", "b", lambda x, y: F.coalesce(x != y, F.lit(True))), lambda v: v)
    return lines.join(after, "doc_id").select("doc_id", F.size(changed).cast("long").alias("n"))


@query("j06_comparison_counts", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j06(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j14_names_one_to_one")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Items of one brand and size paired by their names, best first."""
    parts = table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("g"), "p_name", "p_partkey")
    a, b = parts.filter("p_partkey % 2 = 0").select("g", "p_name"), parts.filter("p_partkey % 2 = 1").select("g", "p_name")
    return linkage.greedy_pairs(linkage.fuzzy_candidates(a, b, "g", "p_name", 55.0), "g", "a", "b", "score")


@query("j19_pair_files")
def j19(spark: SparkSession, d: str) -> DataFrame:
    """Master and supplier files of one stem's first letters paired one to one by name."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("AB"), (k % 500).cast("string"), F.when(k % 3 == 0, "_master").otherwise("_proof"), F.when(k % 7 == 0, "_v2").otherwise(""))
    files = table(spark, d, "part").select((k % 50).alias("g"), text.role_of_name(name).alias("role"), F.concat(text.without_role(name), F.lit("#"), k.cast("string")).alias("stem"))
    a, b = files.filter("role = 'master'").select("g", "stem"), files.filter("role = 'supplier'").select("g", "stem")
    return linkage.best_fuzzy_pairs(a, b, "g", "stem", 40.0)


@query("j25_confirmed_lookup", "WITH c AS (SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2) SELECT s.source, coalesce(x.doc_id, y.doc_id) AS confirmed FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN c x ON s.source = x.source AND x.lang = 'es' LEFT JOIN c y ON s.source = y.source AND y.lang = 'en'")
def j25(spark: SparkSession, d: str) -> DataFrame:
    last = lambda lang: F.max(F.when(F.col("lang") == lang, F.col("doc_id")))
    return table(spark, d, "documents").groupBy("source").agg(F.coalesce(last("es"), last("en")).alias("confirmed"))


@query("j28_reference_lookup", "SELECT n_nationkey, r_name, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def j28(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("j30_best_box_by_class", "WITH a AS (SELECT event_type AS c, arg_max(event_id, struct_pack(v := value, e := event_id)) AS best FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS c, arg_max(event_id, struct_pack(v := value, e := event_id)) AS best FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.c, b.c) AS class, a.best AS best_a, b.best AS best_b FROM a FULL JOIN b ON a.c = b.c")
def j30(spark: SparkSession, d: str) -> DataFrame:
    best = lambda r: F.max(F.when(F.col("user_id") % 2 == r, F.struct("value", "event_id")))["event_id"]
    return table(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(best(0).alias("best_a"), best(1).alias("best_b"))


@query("j37_groups_with_members", "SELECT conv_id, count(*) AS n_members, min(turn) AS first FROM conversations GROUP BY conv_id")
def j37(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_members"), F.min("turn").alias("first"))


@query("j38_suggest_for_refs", "SELECT p_brand, n.p_partkey IS NOT NULL AS found, n.p_partkey AS best FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand AS k, max(p_partkey) AS p_partkey FROM part WHERE p_size > 48 GROUP BY 1) n ON p_brand = k")
def j38(spark: SparkSession, d: str) -> DataFrame:
    best = F.max(F.when(F.col("p_size") > 48, F.col("p_partkey")))
    return table(spark, d, "part").groupBy("p_brand").agg(best.alias("best")).select("p_brand", F.col("best").isNotNull().alias("found"), "best")


@query("c17_field_report", f"WITH f AS ({plain(REFS)}) SELECT CASE WHEN coalesce(raw, '') = '' AND coalesce(other, '') = '' THEN 'both missing' WHEN coalesce(raw, '') = '' OR coalesce(other, '') = '' THEN 'one missing' WHEN upper(raw) = upper(other) THEN 'same' ELSE 'important' END AS verdict, count(*) AS n FROM f GROUP BY 1")
def c17(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.nullif("raw", F.lit("")), F.nullif("other", F.lit(""))
    verdict = F.when(a.isNull() & b.isNull(), "both missing").when(a.isNull() | b.isNull(), "one missing").when(F.upper(a) == F.upper(b), "same").otherwise("important")
    return frame(spark, d, REFS).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("c21_printed_and_encoded", f"WITH f AS ({plain(CODES)}) SELECT id, CASE WHEN regexp_replace(code, '[^0-9]', '', 'g') = b || k THEN 'same' WHEN starts_with(regexp_replace(code, '[^0-9]', '', 'g'), b) THEN 'check digit' ELSE 'different' END AS verdict FROM f")
def c21(spark: SparkSession, d: str) -> DataFrame:
    printed, encoded = F.regexp_replace("code", "[^0-9]", ""), F.concat("b", "k")
    return frame(spark, d, CODES).select("id", F.when(printed == encoded, "same").when(printed.startswith(F.col("b")), "check digit").otherwise("different").alias("verdict"))


@query("a17_flattened_criticals", "SELECT l_orderkey AS doc, 'return' AS kind, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 UNION ALL SELECT o_orderkey, 'status', 0 FROM orders WHERE o_orderstatus = 'P'")
def a17(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("doc"), F.lit("return").alias("kind"), F.col("l_linenumber").alias("line"))
    return lines.union(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.lit("status"), F.lit(0)))


@query("w10_status_of_risk", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'P' THEN 'review' ELSE 'approved' END AS status FROM orders")
def w10(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "rejected").when(s == "P", "review").otherwise("approved").alias("status"))


@query("w13_stock_list", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1000")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(1000)


@query("w20_profile_columns", "SELECT s_suppkey, list_position(['name', 'qty', 'price', 'net'], CASE s_suppkey % 4 WHEN 0 THEN 'qty' WHEN 1 THEN 'net' WHEN 3 THEN 'name' END) AS place FROM supplier")
def w20(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    header = F.when(k == 0, " QTY ").when(k == 1, "Net").when(k == 3, "name")
    roles = F.array(*map(F.lit, ("name", "qty", "price", "net")))
    return table(spark, d, "supplier").select("s_suppkey", F.array_position(roles, F.lower(F.trim(header))).cast("int").alias("place"))


@query("f04_case_insensitive_code", "SELECT p_partkey FROM part WHERE upper(p_brand) = upper('brand#12')")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.upper("p_brand") == F.upper(F.lit("brand#12"))).select("p_partkey")


@query("f10_supplier_keywords", "WITH k AS (SELECT * FROM (VALUES ('a', 'the'), ('a', 'of'), ('b', 'der'), ('b', 'und'), ('c', 'la'), ('c', 'de')) t(s, w)), h AS (SELECT doc_id, s, count(*) FILTER (WHERE regexp_matches(text, '(^|\\s)' || w || '(\\s|$)')) AS n FROM documents, k GROUP BY 1, 2) SELECT doc_id, s AS supplier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS r FROM h WHERE n > 0) WHERE r = 1")
def f10(spark: SparkSession, d: str) -> DataFrame:
    words = {"a": ("the", "of"), "b": ("der", "und"), "c": ("la", "de")}
    # Keyword lists are short settings: one expression for each supplier, no join.
    hits = [F.struct(sum(F.col("text").rlike(rf"(^|\s){w}(\s|$)").cast("int") for w in ws).alias("n"), F.lit(-k).alias("order"), F.lit(s).alias("s")) for k, (s, ws) in enumerate(words.items())]
    best = table(spark, d, "documents").select("doc_id", F.array_max(F.array(*hits)).alias("b")).filter("b.n > 0")
    return best.select("doc_id", F.col("b.s").alias("supplier"))


@query("f16_known_addresses", "SELECT c_custkey, contains(lower(c_name), '#0000001') OR contains(lower(c_mktsegment), 'build') AS known FROM customer")
def f16(spark: SparkSession, d: str) -> DataFrame:
    places = F.array(F.lit("#0000001"), F.lit("build"))
    return table(spark, d, "customer").select("c_custkey", F.exists(places, lambda p: F.lower("c_name").contains(p) | F.lower("c_mktsegment").contains(p)).alias("known"))


@query("f20_missing_slots", "SELECT user_id, array_to_string(list_filter(['signup', 'view', 'click', 'purchase', 'error'], lambda x: NOT list_contains(p, x)), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS p FROM events WHERE value > 60 GROUP BY user_id)")
def f20(spark: SparkSession, d: str) -> DataFrame:
    slots = F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error")))
    present = table(spark, d, "events").filter("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("p"))
    return present.select("user_id", F.array_join(F.array_except(slots, "p"), ",").alias("missing"))


@query("f23_role_levels", "SELECT role, CASE role WHEN 'assistant' THEN 2 WHEN 'user' THEN 1 ELSE 0 END AS level, count(*) AS n FROM conversations GROUP BY 1, 2")
def f23(spark: SparkSession, d: str) -> DataFrame:
    levels = F.create_map(F.lit("assistant"), F.lit(2), F.lit("user"), F.lit(1))
    return table(spark, d, "conversations").groupBy("role", F.coalesce(F.try_element_at(levels, "role"), F.lit(0)).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("s08_pipe_rows_as_items", "SELECT p_partkey AS id, p_brand AS ref, p_size AS qty FROM part")
def s08(spark: SparkSession, d: str) -> DataFrame:
    from .. import sources

    drawn = F.concat(F.lit("| qty | ref |\n| "), F.col("p_size").cast("string"), F.lit(" | "), "p_brand", F.lit(" |"))
    rows = sources.pipe_rows(table(spark, d, "part").select(F.col("p_partkey").alias("id"), drawn.alias("t")), "id", "t")
    w = Window.partitionBy("id").orderBy("row_no")
    named = rows.withColumn("head", F.first("cells").over(w)).filter("row_no > 0").select("id", F.map_from_arrays("head", "cells").alias("m"))
    return named.select("id", F.try_element_at("m", F.lit("ref")).alias("ref"), F.try_element_at("m", F.lit("qty")).cast("int").alias("qty"))


@query("s15_blank_keeps_old", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer")
def s15(spark: SparkSession, d: str) -> DataFrame:
    from .. import sources

    old = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.lit(1).alias("at"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("NEW").alias("segment"))
    return sources.upsert(old, new, ["c_custkey"], ["at"], keep_blank=["segment"])


@query("s29_audit_rows", "SELECT event_id, substring(concat(event_type, ' ', props), 1, 10) AS detail, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type = 'error'")
def s29(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.select("event_id", F.substring(F.concat("event_type", F.lit(" "), "props"), 1, 10).alias("detail"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("m09_word_similarity", "WITH t AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) > 2), s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2) SELECT a, b, shared, CAST(floor(shared * 1000 / (x.n + y.n - shared)) AS BIGINT) AS permille FROM p JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id WHERE shared >= 3")
def m09(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("terms")).withColumn("of", F.struct("doc_id", F.size("terms").alias("n")))
    asked, every = docs.filter("doc_id % 50 = 0").select(F.col("of").alias("i"), "terms"), docs.select(F.col("of").alias("j"), "terms")
    met = products.shared_sums(asked, every, 3).filter("i.doc_id <> j.doc_id").withColumn("shared", F.col("total").cast("long"))
    return met.select(F.col("i.doc_id").alias("a"), F.col("j.doc_id").alias("b"), "shared", F.expr("shared * 1000 div (i.n + j.n - shared)").alias("permille"))


_TIER = "CASE WHEN d.text = i.text THEN 'exact' WHEN contains(d.text, i.text) THEN 'contains' WHEN contains(lower(d.text), lower(i.text)) THEN 'other case' WHEN contains(lower(d.text), lower(substring(i.text, 1, 12))) THEN 'prefix' ELSE 'none' END"


@query("m17_locate_text", f"SELECT * FROM (SELECT d.doc_id, i.item_id, {_TIER} AS tier FROM documents d, benchmark i) WHERE tier <> 'none'")
def m17(spark: SparkSession, d: str) -> DataFrame:
    """Every text sought in every document, with the best tier that finds it."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("search"), F.lower("text").alias("low"), F.lower(F.substring("text", 1, 12)).alias("begin"))
    # The benchmark is a stated set of searches; each block of documents looks for all of them.
    t, found = F.col("text"), table(spark, d, "documents").select("doc_id", "text", F.lower("text").alias("lower")).join(items, F.col("lower").contains(F.col("begin")))
    tier = F.when(t == F.col("search"), "exact").when(t.contains(F.col("search")), "contains").when(F.col("lower").contains(F.col("low")), "other case").otherwise("prefix")
    return found.select("doc_id", "item_id", tier.alias("tier"))


@query("m01_best_ratio_of_names")
def m01_best(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's name against the next one's."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    after = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("other"))
    return s.join(after, "s_suppkey").select("s_suppkey", similarity.token_sort_ratio("s_name", "other").alias("ratio"))
