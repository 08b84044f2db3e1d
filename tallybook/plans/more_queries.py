"""Further queries: fields and lines of text, gates, lookups, roll-ups, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, numbers, text
from ..operators import compare, linkage, timing
from .fixtures import AMOUNTS, CODES, DATES, REFS
from .number_queries import number_sql
from .registry import frame, plain, query, table


@query("n11_amount_with_unit_tokens", f"WITH f AS ({plain(AMOUNTS)}) SELECT id, CAST({number_sql('b')} AS DECIMAL(28,4)) AS amount FROM f", money=("amount",))
def n11(spark: SparkSession, d: str) -> DataFrame:
    units = "cartons?|pieces|pcs|szt|kg"
    s = F.concat("b", F.when(F.col("id") % 2 == 0, " pcs").otherwise("cartons"))
    return frame(spark, d, AMOUNTS).select("id", numbers.parse_number(F.trim(F.regexp_replace(s, f"(?i)({units})", ""))).cast("decimal(28,4)").alias("amount"))


@query("n16_list_differences", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '2' WHEN p_size % 5 = 0 THEN '1' ELSE '' END AS places FROM part")
def n16(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    a, b = F.array(F.lit(0), size), F.when(size % 3 == 0, F.array(F.lit(0))).when(size % 5 == 0, F.array(F.lit(0), size + 1)).otherwise(F.array(F.lit(0), size))
    gap = F.when(size % 3 == 0, 2).when(~F.get(a, F.lit(1)).eqNullSafe(F.get(b, F.lit(1))), 1)
    differ = F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), lambda v: v)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.size(differ) > 0, gap.cast("string")).otherwise("").alias("places"))


@query("n17_cells_differ", f"WITH f AS ({plain(REFS)}) SELECT id, lower(trim(coalesce(raw, ''))) <> lower(trim(coalesce(other, ''))) AS differ FROM f")
def n17(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return frame(spark, d, REFS).select("id", (flat(F.col("raw")) != flat(F.col("other"))).alias("differ"))


@query("n19_dimensions_close", "SELECT p_partkey AS id, abs(p_size - (p_size + p_size % 4)) * 100 <= 3 * greatest(p_size, p_size + p_size % 4) AS close FROM part")
def n19(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array(F.col("p_size"), F.lit(100)), F.array(F.col("p_size") + F.col("p_size") % 4, F.lit(100))
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) * 100 <= F.greatest(x, y) * 3), lambda v: v)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), near.alias("close"))


@query("d05_strict_dates", f"WITH f AS ({plain(DATES)}) SELECT id, coalesce(TRY_CAST(CASE WHEN regexp_matches(a, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN a END AS DATE), CAST(try_strptime(CASE WHEN regexp_matches(a, '^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}$') THEN a END, '%d.%m.%Y') AS DATE), CAST(try_strptime(CASE WHEN regexp_matches(a, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') THEN a END, '%Y/%m/%d') AS DATE)) AS d FROM f")
def d05(spark: SparkSession, d: str) -> DataFrame:
    forms = (("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("dd.MM.yyyy", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"))
    readings = [F.when(F.col("a").rlike(p), F.try_to_timestamp("a", F.lit(f))).cast("date") for f, p in forms]
    return frame(spark, d, DATES).select("id", F.coalesce(*readings).alias("d"))


@query("t09_bare_text", "SELECT doc_id, length(regexp_replace(lower(translate(text, 'áàâäãéèêëíìîïòôöõúùûüçñóÁÀÂÄÉÈÊËÍÎÏÔÖÚÙÛÜÇÑÓ', 'aaaaaeeeeiiiioooouuuucnoAAAAEEEEIIIOOUUUUCNO')), '[^a-z]', '', 'g')) AS n_letters FROM documents")
def t09(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(F.regexp_replace(text.bare_text(F.col("text")), "[^a-z]", "")).cast("long").alias("n_letters"))


@query("t11_dictionary", "SELECT p_partkey AS id, regexp_replace(regexp_replace(concat(p_name, ' box of foil'), '\\bbox\\b', 'carton', 'g'), '\\bfoil\\b', 'film', 'g') AS s FROM part")
def t11(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat("p_name", F.lit(" box of foil"))
    for word, other in (("box", "carton"), ("foil", "film")):
        s = F.regexp_replace(s, rf"(?U)\b{word}\b", other)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))


@query("t26_gtin_lengths", f"WITH f AS ({plain(CODES)}), g AS (SELECT id, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM f) SELECT length(d) AS n_digits, count(*) AS n FROM g GROUP BY 1")
def t26(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, CODES).groupBy(F.length(codes.digits_only(F.col("code"))).cast("long").alias("n_digits")).agg(F.count(F.lit(1)).alias("n"))


@query("t28_file_names", "SELECT p_partkey AS id, concat('AB', CAST(p_partkey AS VARCHAR)) AS ref, CASE p_partkey % 3 WHEN 0 THEN 'CARTON' WHEN 1 THEN 'POUCH' END AS kind, CAST(p_size % 20 AS INT) AS revision FROM part")
def t28(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("AB"), k.cast("string"), F.when(k % 3 == 0, "_carton").when(k % 3 == 1, " POUCH").otherwise(""), F.lit("_rev"), (F.col("p_size") % 20).cast("string"), F.lit(".pdf"))
    kind = F.upper(F.regexp_extract(name, "(?i)(carton|pouch|label|leaflet)", 1))
    return table(spark, d, "part").select(k.alias("id"), F.regexp_extract(name, "^([A-Z]+[0-9]+)", 1).alias("ref"), F.nullif(kind, F.lit("")).alias("kind"), F.regexp_extract(name, "(?i)rev([0-9]+)", 1).cast("int").alias("revision"))


@query("t30_glued_reference", "WITH m AS (SELECT DISTINCT p_brand AS ref FROM part), i AS (SELECT p_partkey AS id, concat(p_brand, p_type) AS glued FROM part) SELECT id, max(ref) AS ref FROM i JOIN m ON starts_with(glued, ref) GROUP BY id")
def t30(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    # Equal prefixes meet: a candidate of each length from 2 to 12 instead of a join on startswith.
    items = parts.select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("glued"))
    heads = items.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.lit(12)), lambda n: F.substr("glued", F.lit(1), n))).alias("ref"))
    return heads.join(parts.select(F.col("p_brand").alias("ref")).distinct(), "ref").groupBy("id").agg(F.max("ref").alias("ref"))


@query("t37_difference_category", "SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'wording' WHEN contains(text, 'der') THEN 'language' WHEN contains(text, '1') THEN 'number' ELSE 'other' END AS category FROM documents")
def t37(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(t.contains("the"), "wording").when(t.contains("der"), "language").when(t.contains("1"), "number").otherwise("other").alias("category"))


@query("t44_header_fields", "SELECT o_orderkey AS doc, unnest(['number', 'date', 'currency']) AS field, unnest([CAST(o_orderkey AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'USD']) AS value FROM orders")
def t44(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Invoice No: "), F.col("o_orderkey").cast("string"), F.lit(" ;\nDate: "), F.col("o_orderdate").cast("date").cast("string"), F.lit("\nCURRENCY usd total"))
    fields = (("number", [r"(?i)invoice no\.?:\s*([0-9]+)"]), ("date", [r"(?im)^date:\s*([0-9\-]+)$"]), ("currency", [r"(?i)currency\s+(\S+)"]))
    found = F.array(*(F.struct(F.lit(n).alias("field"), (text.currency(text.first_match(raw, p)) if n == "currency" else text.first_match(raw, p)).alias("value")) for n, p in fields))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(found).alias("f")).select("doc", "f.field", "f.value")


_CONFUSED = ", ".join(f"'{x}{y}', '{y}{x}'" for x, y in text.CONFUSABLE)
_OTHER_AT = "list_filter(range(1, length(own) + 1), lambda i: own[i] <> other[i])"


@query("m04_confused_places", f"WITH f AS (SELECT id, concat('AB', lpad(CAST(id AS VARCHAR), 5, '0'), 'S') AS own, other FROM ({plain(REFS)})) SELECT id, CASE WHEN length(own) = length(other) AND len(list_filter({_OTHER_AT}, lambda i: NOT list_contains([{_CONFUSED}], own[i] || other[i]))) = 0 THEN len({_OTHER_AT}) END AS n FROM f")
def m04(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("AB"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("S"))
    places = text.confused_places(own, F.col("other"))
    return frame(spark, d, REFS).select("id", F.when(places.isNotNull(), F.size(places)).cast("long").alias("n"))


@query("m12_pair_score", "WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS w, p_size % 2 AS role FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) * CASE WHEN a.role = b.role THEN 0.5 ELSE 1.0 END, 6) AS score FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1", money=("score",))
def m12(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_type"), " ")).alias("w"), (F.col("p_size") % 2).alias("role"))
    a, b = t.select(F.col("p_partkey").alias("a"), F.col("w").alias("wa"), F.col("role").alias("ra")), t.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("w").alias("wb"), F.col("role").alias("rb"))
    return a.join(b, "a").select("a", "b", F.round(text.shared_of_larger(F.col("wa"), F.col("wb")) * F.when(F.col("ra") == F.col("rb"), 0.5).otherwise(1.0), 6).alias("score"))


@query("m14_token_variants", "SELECT p_partkey AS id, len(list_distinct(list_concat(w, list_transform(w, lambda x: translate(x, '8', 'b'))))) AS n FROM (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || CAST(p_partkey AS VARCHAR)), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM part)")
def m14(spark: SparkSession, d: str) -> DataFrame:
    w = text.tokens(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(F.array_union(w, F.transform(w, lambda x: F.translate(x, "8", "b")))).cast("long").alias("n"))


@query("j03_unused_tokens", "SELECT e.event_id, c_name FROM events e JOIN customer ON user_id = c_custkey WHERE event_type = 'signup' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50)")
def j03(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'signup' and not coalesce(value > 50, false)")
    return e.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


@query("j11_resolved_items", "SELECT l_partkey AS item, CASE WHEN p_partkey IS NOT NULL THEN 'matched' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def j11(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").filter("p_size > 10").select("p_partkey")
    items = table(spark, d, "lineitem").select("l_partkey").distinct()
    return items.join(known, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.col("l_partkey").alias("item"), F.when(F.col("p_partkey").isNotNull(), "matched").otherwise("ambiguous").alias("status"))


@query("j15_descriptions", "WITH a AS (SELECT l_partkey AS ref, min(l_orderkey) AS first FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS ref, min(l_orderkey) AS first FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT coalesce(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NULL THEN 'missing in a' WHEN b.ref IS NULL THEN 'missing in b' WHEN a.first % 10 = b.first % 10 THEN 'same' ELSE 'different' END AS verdict FROM a FULL JOIN b ON a.ref = b.ref")
def j15(spark: SparkSession, d: str) -> DataFrame:
    first = lambda s: F.min(F.when(F.col("l_linestatus") == s, F.col("l_orderkey")))
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ref")).agg(first("F").alias("a"), first("O").alias("b"))
    return g.select("ref", F.when(F.col("a").isNull(), "missing in a").when(F.col("b").isNull(), "missing in b").when(F.col("a") % 10 == F.col("b") % 10, "same").otherwise("different").alias("verdict"))


@query("j18_customs_audit", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'no master' WHEN s_suppkey IS NULL THEN 'no exporter' WHEN p_size % 5 = s_nationkey % 5 THEN 'ok' ELSE 'differs' END AS verdict FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 20 <> 0) ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 30 <> 0) ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'")
def j18(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    master = table(spark, d, "part").filter("p_partkey % 20 <> 0").select("p_partkey", "p_size")
    exporters = table(spark, d, "supplier").filter("s_suppkey % 30 <> 0").select("s_suppkey", "s_nationkey")
    verdict = F.when(F.col("p_partkey").isNull(), "no master").when(F.col("s_suppkey").isNull(), "no exporter").when(F.col("p_size") % 5 == F.col("s_nationkey") % 5, "ok").otherwise("differs")
    return lines.join(master, F.col("l_partkey") == F.col("p_partkey"), "left").join(exporters, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_partkey", "l_linenumber", verdict.alias("verdict"))


@query("j23_drift", "WITH n AS (SELECT source, max(doc_id) AS newest FROM documents GROUP BY 1), c AS (SELECT source, max(doc_id) AS confirmed FROM documents WHERE lang = 'en' GROUP BY 1) SELECT n.source, newest, confirmed, confirmed IS NOT NULL AND confirmed < newest AS drift FROM n LEFT JOIN c ON n.source = c.source")
def j23(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("newest"), F.max(F.when(F.col("lang") == "en", F.col("doc_id"))).alias("confirmed"))
    return g.withColumn("drift", F.col("confirmed").isNotNull() & (F.col("confirmed") < F.col("newest")))


@query("j24_group_members", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS member, c_name FROM events JOIN customer ON CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) = c_custkey")
def j24(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "member"))
    return e.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("member") == F.col("c_custkey")).select("event_id", "member", "c_name")


@query("j35_forwarding_order", "SELECT o_orderkey, coalesce(c_name, 'unknown') AS consignee, coalesce(n_name, '') AS country, c_name IS NOT NULL AND n_name IS NOT NULL AS complete FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j35(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").filter("c_custkey % 9 <> 0").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("consignee"), F.coalesce("n_name", F.lit("")).alias("country"), (F.col("c_name").isNotNull() & F.col("n_name").isNotNull()).alias("complete"))


@query("j39_later_lists_win", "SELECT l_partkey, l_quantity AS weight FROM (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def j39(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("m"))
    return best.select("l_partkey", F.col("m.l_quantity").alias("weight"))


@query("c13_section_lines", "WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS place, CASE WHEN length(unnest(string_split(text, chr(10)))) < 40 THEN 'short' ELSE 'long' END AS section FROM documents) SELECT doc_id, section, count(*) AS n, min(place) AS first FROM l GROUP BY 1, 2")
def c13(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.groupBy("doc_id", F.when(F.length("line") < 40, "short").otherwise("long").alias("section")).agg(F.count(F.lit(1)).alias("n"), (F.min("place") + 1).alias("first"))


@query("c15_grid_cells", "WITH a AS (SELECT l_orderkey AS r, l_linenumber AS c, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_orderkey AS r, l_linenumber AS c, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, CASE WHEN a.v IS NULL THEN 'only b' WHEN b.v IS NULL THEN 'only a' WHEN abs(a.v - b.v) <= 5 THEN 'same' ELSE 'changed' END AS verdict FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c")
def c15(spark: SparkSession, d: str) -> DataFrame:
    value = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c")).agg(value("F").alias("a"), value("O").alias("b"))
    return g.select("r", "c", F.when(F.col("a").isNull(), "only b").when(F.col("b").isNull(), "only a").when(F.abs(F.col("a") - F.col("b")) <= 5, "same").otherwise("changed").alias("verdict"))


@query("c26_sections_of_findings", "SELECT CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' THEN 'review' ELSE 'fine' END AS section, count(*) AS n, count(DISTINCT l_orderkey) AS n_docs FROM lineitem GROUP BY 1")
def c26(spark: SparkSession, d: str) -> DataFrame:
    section = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "review").otherwise("fine")
    return table(spark, d, "lineitem").groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_docs"))


@query("c27_annotations", "SELECT DISTINCT least(p_brand, p_type) AS x, greatest(p_brand, p_type) AS y FROM part")
def c27(spark: SparkSession, d: str) -> DataFrame:
    pair = F.array_sort(F.array("p_brand", "p_type"))
    return table(spark, d, "part").select(F.get(pair, F.lit(0)).alias("x"), F.get(pair, F.lit(1)).alias("y")).distinct()


@query("a11_counts", "SELECT count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad, count(*) FILTER (WHERE toxic IS NULL) AS open FROM labels")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic").isNull()).alias("open"))


@query("a15_module_totals", "SELECT o_orderpriority AS module, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS errors, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'error' ELSE 'ok' END AS risk FROM orders GROUP BY 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("module")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"))
    return g.withColumn("risk", compare.risk(F.col("errors"), F.lit(0), F.lit(0)))


@query("a27_confirmed_items", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def a27(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    return jobs.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("w03_stale_confirmations", "WITH n AS (SELECT source, max(doc_id) AS newest FROM documents GROUP BY 1) SELECT d.doc_id, d.source FROM documents d JOIN n ON d.source = n.source WHERE d.lang = 'de' AND d.doc_id <> newest ORDER BY d.doc_id LIMIT 1000")
def w03(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    newest = docs.groupBy("source").agg(F.max("doc_id").alias("newest"))
    return docs.filter("lang = 'de'").join(newest, "source").filter("doc_id <> newest").select("doc_id", "source").orderBy("doc_id").limit(1000)


@query("w09_auto_advance", "SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'proforma_otrzymana' END AS target FROM events")
def w09(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "utworzone").when(F.col("event_type") == "view", "proforma_oczekiwana").otherwise("sad_draft")
    target = timing.step_index(F.lit("proforma_otrzymana"))
    return table(spark, d, "events").select("event_id", F.when(timing.step_index(status) < target, "proforma_otrzymana").alias("target"))


@query("w12_last_of_supplier", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, r FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r <= 50")
def w12(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey"))
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("r")).filter("r <= 50")


@query("w16_header_row", "SELECT doc_id, min(place) AS header_row FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS place, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE place < 15 AND CAST(contains(lower(line), 'the') AS INT) + CAST(contains(lower(line), 'of') AS INT) + CAST(contains(lower(line), 'and') AS INT) >= 2 GROUP BY doc_id")
def w16(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 15)).alias("place", "line"))
    signals = sum(F.lower("line").contains(s).cast("int") for s in ("the", "of", "and"))
    return lines.filter(signals >= 2).groupBy("doc_id").agg(F.min("place").alias("header_row"))


@query("w17_column_roles", "WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS col, max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 2 ELSE 1 END) AS score FROM lineitem GROUP BY 1, 2) SELECT doc, col, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, col) AS r FROM c) WHERE r = 1")
def w17(spark: SparkSession, d: str) -> DataFrame:
    score = F.max(F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1))
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("col")).agg(score.alias("score"))
    return linkage.latest(c, ["doc"], [F.desc("score"), F.col("col")])


@query("f07_document_type_counts", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a >= b AND a > 0 THEN 'first' WHEN b > 0 THEN 'second' ELSE 'inny' END AS kind FROM (SELECT CAST(contains(text, 'der') AS INT) + CAST(contains(text, 'und') AS INT) AS a, CAST(contains(text, 'les') AS INT) + CAST(contains(text, 'une') AS INT) AS b FROM documents)) GROUP BY kind")
def f07(spark: SparkSession, d: str) -> DataFrame:
    hits = lambda *ws: sum(F.col("text").contains(w).cast("int") for w in ws)
    a, b = hits("der", "und"), hits("les", "une")
    return table(spark, d, "documents").groupBy(F.when((a >= b) & (a > 0), "first").when(b > 0, "second").otherwise("inny").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("f13_total_rows", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE regexp_matches(lower(line), '^(grand total|total|sum)\\b') OR (length(line) BETWEEN 1 AND 25 AND regexp_matches(lower(line), 'the')) GROUP BY doc_id")
def f13(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    marked = F.lower("line").rlike(r"^(grand total|total|sum)\b") | (F.length("line").between(1, 25) & F.lower("line").rlike("the"))
    return lines.filter(marked).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("f24_row_level_security", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority = '' OR o_orderpriority LIKE '2%'")
def f24(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").filter(p.isNull() | (p == "") | p.startswith("2")).select("o_orderkey", "o_orderpriority")


@query("k02_by_supplier", "SELECT l_suppkey AS supplier, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, count(*) FILTER (WHERE l_returnflag = 'A') AS warnings, CAST(max(l_shipdate) AS DATE) AS last_at FROM lineitem GROUP BY 1")
def k02(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("l_returnflag") == s)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("total"), n("R").alias("errors"), n("A").alias("warnings"), F.max("l_shipdate").cast("date").alias("last_at"))
