"""Queries of aggregation and reporting (A, K). Formulas that reports leave open are our choice, as noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table


@query("a01_customs_positions", """WITH i AS (SELECT l_suppkey AS exporter, p_size AS cn, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS net, l_orderkey, p_brand, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS sent FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'),
  g AS (SELECT exporter, cn, sum(qty) AS qty, sum(net) AS net, count(DISTINCT l_orderkey) AS n_docs, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, max(sent) AS sent FROM i GROUP BY exporter, cn) SELECT *, CAST(row_number() OVER (PARTITION BY exporter ORDER BY cn) AS INT) AS position FROM g""", money=("qty", "net"))
def a01(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").filter("l_linestatus = 'F'").join(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    net = F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice").cast("decimal(18,2)"))
    g = items.groupBy(F.col("l_suppkey").alias("exporter"), F.col("p_size").alias("cn")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"),
        F.sum(net).alias("net"),
        F.countDistinct("l_orderkey").alias("n_docs"),
        F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("sent"),
    )
    return g.withColumn("position", F.row_number().over(Window.partitionBy("exporter").orderBy("cn")))


@query("a02_batch_totals", "SELECT o_custkey % 100 AS batch, count(*) AS n_docs, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(DISTINCT o_orderpriority) AS n_terms, bool_and(o_orderstatus <> 'P') AS all_confirmed FROM orders GROUP BY 1", money=("total",))
def a02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("batch")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"), F.countDistinct("o_orderpriority").alias("n_terms"), F.bool_and(F.col("o_orderstatus") != "P").alias("all_confirmed"))


@query("a03_samples_of_invoices", "SELECT o_orderkey FROM orders o WHERE o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def a03(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderkey % 3 = 0").join(returned, "o_orderkey", "left_semi").select("o_orderkey")


@query("a04_weights", "SELECT l_partkey, sum(TRY_CAST(CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS DECIMAL(18,2))) AS weight FROM lineitem GROUP BY l_partkey HAVING sum(TRY_CAST(CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS DECIMAL(18,2))) IS NOT NULL", money=("weight",))
def a04(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") % 4 == 0, "n/a").otherwise(F.col("l_quantity").cast("decimal(18,2)").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(raw.try_cast("decimal(18,2)")).alias("weight")).filter("weight is not null")


@query("a05_repeated_items", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("a06_index_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long, count(DISTINCT CASE WHEN lang <> 'en' THEN source END) AS n_sources, max(doc_id) AS last FROM documents")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.countDistinct(F.when(F.col("lang") != "en", F.col("source"))).alias("n_sources"), F.max("doc_id").alias("last"))


@query("a07_supplier_errors", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_errors, CAST(floor(count(*) FILTER (WHERE l_returnflag = 'R') * 1000 / count(*)) AS BIGINT) AS permille, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY l_suppkey")
def a07(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_errors"), F.max("l_shipdate").cast("date").alias("last"))
    return g.withColumn("permille", F.expr("n_errors * 1000 div n"))


@query("a09_month_cost", "SELECT coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'", money=("cost",))
def a09(spark: SparkSession, d: str) -> DataFrame:
    month = table(spark, d, "events").filter("ts >= timestamp_ntz '2024-01-01' and ts < timestamp_ntz '2024-02-01'")
    return month.agg(F.coalesce(F.sum(F.col("value").cast("decimal(18,4)")), F.lit(0)).alias("cost"))


@query("a10_budget", "SELECT user_id, spent, spent * 100 >= 80 * 2000 AND spent < 2000 AS near, spent >= 2000 AS over FROM (SELECT user_id, round(sum(CAST(value AS DECIMAL(18,4))), 2) AS spent FROM events GROUP BY user_id)", money=("spent",))
def a10(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).alias("spent"))
    return g.select("user_id", "spent", ((F.col("spent") * 100 >= 80 * 2000) & (F.col("spent") < 2000)).alias("near"), (F.col("spent") >= 2000).alias("over"))


@query("a22_first_events", "SELECT user_id, CAST(min(ts) FILTER (WHERE event_type = 'signup') AS DATE) AS signup, CAST(min(ts) FILTER (WHERE event_type = 'purchase') AS DATE) AS purchase, CAST(min(ts) FILTER (WHERE event_type = 'error') AS DATE) AS error FROM events GROUP BY user_id")
def a22(spark: SparkSession, d: str) -> DataFrame:
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts"))).cast("date").alias(k)
    return table(spark, d, "events").groupBy("user_id").agg(first("signup"), first("purchase"), first("error"))


@query("a24_first_spelling", "SELECT norm, min(p_partkey) AS first_id FROM (SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS norm FROM part) GROUP BY norm")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.regexp_replace(F.upper("p_brand"), "[^A-Z0-9]", "").alias("norm")).agg(F.min("p_partkey").alias("first_id"))


@query("a25_batch_status", "SELECT o_custkey AS batch, count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS confirmed, count(*) FILTER (WHERE o_orderstatus = 'P') AS errors, bool_and(o_orderstatus IN ('F', 'O')) AS ready FROM orders GROUP BY o_custkey")
def a25(spark: SparkSession, d: str) -> DataFrame:
    confirmed = F.col("o_orderstatus").isin("F", "O")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count(F.lit(1)).alias("total"), F.count_if(confirmed).alias("confirmed"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"), F.bool_and(confirmed).alias("ready"))


@query("a26_rows_of_ready_batches", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'P')) AND l_returnflag = 'R'")
def a26(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ready = orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("ready")).filter("ready").select("o_custkey")
    of_ready = orders.join(ready, "o_custkey", "left_semi").select("o_orderkey")
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return lines.join(of_ready, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("a29_profile_diff", "SELECT k, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM (SELECT p_partkey, 'brand' AS k, p_brand AS a, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_brand END AS b FROM part UNION ALL SELECT p_partkey, 'type', CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END, p_type FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END FROM part) WHERE a IS DISTINCT FROM b GROUP BY 1, 2")
def a29(spark: SparkSession, d: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    full = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    a = full(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(p % 5 != 0, F.col("p_type")), F.lit("size"), size))
    b = full(F.create_map(F.lit("brand"), F.when(p % 4 == 0, "other").otherwise(F.col("p_brand")), F.lit("type"), F.col("p_type"), F.lit("size"), F.when(p % 6 != 0, size)))
    both = F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), "added").when(y.isNull(), "removed").when(x != y, "changed"))
    return table(spark, d, "part").select(F.explode(both).alias("k", "change")).filter("change is not null").groupBy("k", "change").agg(F.count(F.lit(1)).alias("n"))


@query("a30_merged_profile", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'n' || CAST(s_nationkey AS VARCHAR) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'alpha,beta,gamma' ELSE 'alpha,beta' END AS issues FROM supplier")
def a30(spark: SparkSession, d: str) -> DataFrame:
    new_name = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).otherwise("")
    old, new = F.array(F.lit("alpha"), F.lit("beta")), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("BETA"), F.lit("Gamma"))).otherwise(F.array(F.lit("Alpha")))
    issues = F.array_union(old, F.transform(new, F.lower))
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.nullif(new_name, F.lit("")), "s_name").alias("name"), F.array_join(issues, ",").alias("issues"))


@query("a31_composite_key", "SELECT user_id, event_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 500")
def a31(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("_", F.lit("sup_x"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    rows = table(spark, d, "events").filter("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(500).select(key.alias("key"))
    part = lambda k: F.regexp_extract("key", r"^(.*)_([0-9]+)_([0-9]+)$", k).cast("long")
    return rows.select(part(2).alias("user_id"), part(3).alias("event_id"))


@query("k01_totals", "SELECT count(*) AS total_docs, count(DISTINCT o_custkey) AS active_users, count(*) FILTER (WHERE o_orderstatus = 'F') AS error_docs, count(*) FILTER (WHERE o_orderstatus = 'O') AS ok_docs, count(*) FILTER (WHERE o_orderstatus = 'P') AS warning_docs FROM orders")
def k01(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total_docs"), F.countDistinct("o_custkey").alias("active_users"), n("F").alias("error_docs"), n("O").alias("ok_docs"), n("P").alias("warning_docs"))


@query("k03_by_month", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS errors FROM orders GROUP BY 1")
def k03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"))


@query("k04_scorecard", "WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS bad, count(*) FILTER (WHERE l_returnflag = 'A') AS doubtful FROM lineitem GROUP BY l_suppkey), p AS (SELECT *, 100 - CAST((bad * 100 + doubtful * 50) // n AS BIGINT) AS score FROM s) SELECT l_suppkey, n, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 45 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade, CAST(rank() OVER (ORDER BY score DESC) AS INT) AS place FROM p")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """Score: 100 less a point for each per cent of errors and half for doubts; grades at 80, 60, 45, 30 (our choice)."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.count_if(F.col("l_returnflag") == "A").alias("doubtful"))
    p = s.withColumn("score", 100 - F.expr("(bad * 100 + doubtful * 50) div n"))
    score = F.col("score")
    grade = F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 45, "C").when(score >= 30, "D").otherwise("F")
    # A score is one of a hundred values: ranks come from their counts, so suppliers are not sorted in one task.
    counts = p.groupBy("score").agg(F.count(F.lit(1)).alias("m"))
    above = F.coalesce(F.sum("m").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.join(F.broadcast(counts.select("score", (above + 1).cast("int").alias("place"))), "score").select("l_suppkey", "n", "score", grade.alias("grade"), "place")


@query("k05_duplicate_clusters", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(DISTINCT o_totalprice) > 1 AS amounts_differ FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def k05(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.min("o_totalprice") != F.max("o_totalprice")).alias("amounts_differ"))
    return g.filter("n > 1")


@query("k06_lead_times", "SELECT o_orderpriority, count(*) AS n, min(lead) AS shortest, CAST(quantile_disc(lead, 0.5) AS BIGINT) AS middle FROM (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS lead FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate) GROUP BY o_orderpriority")
def k06(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("shipped"))
    leads = table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", F.date_diff("shipped", F.col("o_orderdate").cast("date")).cast("long").alias("lead"))
    middle = F.expr("percentile_disc(0.5) within group (order by lead)").cast("long")
    return leads.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("lead").alias("shortest"), middle.alias("middle"))


@query("k07_stock_cover", "WITH u AS (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS used FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT p_partkey, p_size * 10 - coalesce(used, 0) AS balance, CASE WHEN coalesce(used, 0) > 0 THEN CAST(floor(p_size * 10 * 30 / used) AS BIGINT) END AS days, CASE WHEN coalesce(used, 0) = 0 THEN 'green' WHEN p_size * 300 < 30 * used THEN 'red' WHEN p_size * 300 < 60 * used THEN 'amber' ELSE 'green' END AS level FROM part LEFT JOIN u ON p_partkey = l_partkey", money=("balance",))
def k07(spark: SparkSession, d: str) -> DataFrame:
    """Days of cover with a month of 30 days, on the gross stock (our choice)."""
    used = table(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("used"))
    u, stock = F.coalesce("used", F.lit(0).cast("decimal(18,2)")), F.col("p_size") * 10
    level = F.when(u == 0, "green").when(stock * 30 < u * 30, "red").when(stock * 30 < u * 60, "amber").otherwise("green")
    return table(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (stock - u).alias("balance"), F.when(u > 0, F.floor((stock * 30).cast("double") / u.cast("double"))).cast("long").alias("days"), level.alias("level"))


@query("k08_cost_shares", "SELECT event_type, cost, CAST(floor(CAST(cost AS DOUBLE) * 1000 / CAST(sum(cost) OVER () AS DOUBLE)) AS BIGINT) AS permille FROM (SELECT event_type, sum(CAST(value AS DECIMAL(18,4))) AS cost FROM events GROUP BY event_type)", money=("cost",))
def k08(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("cost"))
    # One row for each event type.
    return g.withColumn("permille", F.floor(F.col("cost").cast("double") * 1000 / F.sum("cost").over(Window.partitionBy(F.lit(1))).cast("double")).cast("long"))


@query("k09_days_with_zeros", "SELECT CAST(day AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON day = d")
def k09(spark: SparkSession, d: str) -> DataFrame:
    days = spark.sql("select explode(sequence(date '2024-01-28', date '2024-02-03')) as day")
    counts = table(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("k10_search", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '99') UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '99') UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE contains(lower(p_name), '99')")
def k10(spark: SparkSession, d: str) -> DataFrame:
    hits = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("name")).filter(F.lower("name").contains("99")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    return hits[0].union(hits[1]).union(hits[2])


@query("g01_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", money=("qty",))
def g01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))
