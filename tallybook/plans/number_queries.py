"""Queries over numbers and dates (N and D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from .fixtures import AMOUNTS, DATES
from .registry import frame, plain, query, table

_DASHED = "translate(trim({s}), '‐‑‒–—−', '------')"


def number_sql(s: str) -> str:
    """The parser of numbers as one SQL expression."""
    t = _DASHED.format(s=s)
    c = f"regexp_replace({t}, '[€$£¥\\s]', '', 'g')"
    dots, commas = f"(length({c}) - length(replace({c}, '.', '')))", f"(length({c}) - length(replace({c}, ',', '')))"
    dot_last = f"strpos(reverse({c}), '.') < strpos(reverse({c}), ',')"
    one = f"(regexp_matches({c}, '^-*[0-9]+[.,][0-9]{{3}}$') AND NOT regexp_matches({c}, '^-*0[.,]'))"
    digits = f"""CASE WHEN {dots} = 0 AND {commas} = 0 THEN {c}
      WHEN {dots} + {commas} = 1 THEN CASE WHEN {one} THEN replace(replace({c}, '.', ''), ',', '') ELSE replace({c}, ',', '.') END
      WHEN {commas} = 0 THEN replace({c}, '.', '') WHEN {dots} = 0 THEN replace({c}, ',', '')
      WHEN {dots} = 1 AND {dot_last} THEN replace({c}, ',', '')
      WHEN {dots} = 1 OR {commas} = 1 THEN replace(replace({c}, '.', ''), ',', '.') END"""
    return f"""CASE WHEN regexp_matches({t}, '^[-+]?[0-9]+\\.?[0-9]*[eE][-+]?[0-9]+$') THEN TRY_CAST(TRY_CAST({t} AS DOUBLE) AS DECIMAL(38,10))
      WHEN length({t}) <= 50 AND NOT regexp_matches({t}, '[0-9][,.][0-9][0-9.,]*-[0-9]') AND {dots} <= 3 AND {commas} <= 3
      THEN TRY_CAST(({digits}) AS DECIMAL(38,10)) END"""


_PARSED = f"WITH f AS ({plain(AMOUNTS)}), p AS (SELECT id, a, b, {number_sql('a')} AS x, {number_sql('b')} AS y FROM f) "


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, AMOUNTS).withColumn("x", numbers.parse_number(F.col("a"))).withColumn("y", numbers.parse_number(F.col("b")))


@query("n01_normalize_number", _PARSED + "SELECT id, CAST(x AS DECIMAL(28,4)) AS x, CAST(y AS DECIMAL(28,4)) AS y FROM p", money=('x', 'y'))
def n01(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("id", F.col("x").cast("decimal(28,4)").alias("x"), F.col("y").cast("decimal(28,4)").alias("y"))


def _equal_sql(tolerance: str) -> str:
    return f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN x = y THEN true WHEN x = 0 OR y = 0 THEN abs(x - y) <= 0.0001 ELSE {tolerance} END"


@query("n02_numbers_equal", _PARSED + f"SELECT id, {_equal_sql('false')} AS exact, {_equal_sql('CAST(abs(x - y) AS DECIMAL(28,4)) * 100 <= CAST(greatest(abs(x), abs(y)) AS DECIMAL(28,4)) * 2')} AS within_two FROM p")
def n02(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _parsed(spark, d).select("id", numbers.numbers_equal(x, y).alias("exact"), numbers.numbers_equal(x, y, 2.0).alias("within_two"))


@query("n03_rounding_only", _PARSED + "SELECT id, coalesce(round(x, 2) = round(y, 2), false) AS two, coalesce(round(x, 0) = round(y, 0), false) AS none FROM p")
def n03(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _parsed(spark, d).select("id", numbers.differ_only_by_rounding(x, y, 2).alias("two"), numbers.differ_only_by_rounding(x, y, 0).alias("none"))


@query("n04_number_change", _PARSED + "SELECT id, CAST(y - x AS DECIMAL(28,2)) AS delta, CASE WHEN x <> 0 THEN CAST(floor(CAST(abs(y - x) AS DOUBLE) / CAST(abs(x) AS DOUBLE) * 100) AS DECIMAL(18,1)) END AS pct FROM p", money=('delta', 'pct'))
def n04(spark: SparkSession, d: str) -> DataFrame:
    c = numbers.number_change(F.col("x"), F.col("y"))
    return _parsed(spark, d).select("id", c["delta"].cast("decimal(28,2)").alias("delta"), F.floor(F.abs(F.col("y") - F.col("x")).cast("double") / F.abs("x").cast("double") * 100).cast("decimal(18,1)").alias("pct"))


@query("n05_checksum", """WITH i AS (SELECT l_orderkey AS doc, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS net, CAST(l_quantity AS DECIMAL(18,2)) AS qty FROM lineitem),
  s AS (SELECT doc, CAST(sum(coalesce(net, qty * 1000)) AS DECIMAL(28,2)) AS total, count(*) AS n_lines, count(*) FILTER (WHERE net IS NULL) AS without_net FROM i GROUP BY doc)
  SELECT doc, total, CAST(o_totalprice AS DECIMAL(28,2)) AS declared, n_lines, without_net,
    CASE WHEN abs(CAST(o_totalprice AS DECIMAL(28,2))) < 0.01 THEN abs(total) < 0.01 ELSE abs(total - CAST(o_totalprice AS DECIMAL(28,2))) * 100 <= abs(CAST(o_totalprice AS DECIMAL(28,2))) * 5 END AS agrees FROM s JOIN orders ON doc = o_orderkey""", money=('total', 'declared'))
def n05(spark: SparkSession, d: str) -> DataFrame:
    net = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice").cast("decimal(18,2)"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), net.alias("net"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    sums = items.groupBy("doc").agg(F.sum(F.coalesce("net", F.col("qty") * 1000)).cast("decimal(28,2)").alias("total"), F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("net").isNull()).alias("without_net"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_totalprice").cast("decimal(28,2)").alias("declared"))
    gap = F.abs(F.col("total") - F.col("declared"))
    return sums.join(orders, "doc").select("doc", "total", "declared", "n_lines", "without_net", F.when(F.abs("declared") < 0.01, F.abs("total") < 0.01).otherwise(gap * 100 <= F.abs("declared") * 5).alias("agrees"))


@query("n06_amount_with_unit", f"WITH f AS ({plain(AMOUNTS)}), u AS (SELECT id, concat(b, ' USD') AS s FROM f), c AS (SELECT id, regexp_replace(s, '[A-Za-z\\s]+', '', 'g') AS t FROM u) SELECT id, CAST(round({number_sql('t')}, 4) AS DECIMAL(28,4)) AS amount FROM c", money=('amount',))
def n06(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, AMOUNTS).select("id", numbers.parse_amount(F.concat("b", F.lit(" USD"))).cast("decimal(28,4)").alias("amount"))


@query("n07_same_value_other_notation", _PARSED + "SELECT id, CASE WHEN abs(x - y) < 0.005 AND a <> b THEN concat(a, ' = ', b) END AS note FROM p")
def n07(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("id", F.when((F.abs(F.col("x") - F.col("y")) < 0.005) & (F.col("a") != F.col("b")), F.concat("a", F.lit(" = "), "b")).alias("note"))


_RATES = ", ".join(map(str, numbers.TYPICAL_RATES))


@query("n08_typical_rate", f"""WITH p AS (SELECT s_suppkey AS id, CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS x, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS y FROM supplier JOIN customer ON s_suppkey = c_custkey)
  SELECT id, CASE WHEN CAST(greatest(x, y) AS DOUBLE) / nullif(CAST(least(x, y) AS DOUBLE), 0) BETWEEN 1.000000001 AND 99.999999999 THEN list_filter([{_RATES}]::DOUBLE[], lambda r: abs(CAST(greatest(x, y) AS DOUBLE) / nullif(CAST(least(x, y) AS DOUBLE), 0) - r) < 0.15)[1] END AS rate FROM p""")
def n08(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    x, y = F.abs("s_acctbal").cast("decimal(18,2)"), F.abs("c_acctbal").cast("decimal(18,2)")
    return s.join(c, s.s_suppkey == c.c_custkey).select(F.col("s_suppkey").alias("id"), numbers.typical_rate(x, y).alias("rate"))


@query("n10_number_diff_status", _PARSED + "SELECT id, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN a = b THEN 'ok' WHEN abs(x - y) <= 0.005 THEN 'format' ELSE 'error' END AS status FROM p")
def n10(spark: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.col("x") - F.col("y"))
    return _parsed(spark, d).select("id", F.when(gap.isNull(), None).when(F.col("a") == F.col("b"), "ok").when(gap <= 0.005, "format").otherwise("error").alias("status"))


@query("n12_number_severity", _PARSED + "SELECT id, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN abs(x - y) <= 0.005 THEN 'same' WHEN abs(x) < 0.001 THEN 'error' WHEN CAST(abs(x - y) AS DECIMAL(28,4)) * 1000 <= CAST(abs(x) AS DECIMAL(28,4)) * 5 THEN 'warning' ELSE 'error' END AS severity FROM p")
def n12(spark: SparkSession, d: str) -> DataFrame:
    gap, base = F.abs(F.col("x") - F.col("y")), F.abs("x")
    return _parsed(spark, d).select("id", F.when(gap.isNull(), None).when(gap <= 0.005, "same").when(base < 0.001, "error").when(gap * 1000 <= base * 5, "warning").otherwise("error").alias("severity"))


@query("n13_stock_number", f"""WITH f AS (SELECT id, regexp_replace(b, '\\s', '', 'g') AS c FROM ({plain(AMOUNTS)}) x)
  SELECT id, CAST(TRY_CAST(CASE WHEN contains(c, ',') AND contains(c, '.') THEN CASE WHEN strpos(reverse(c), ',') < strpos(reverse(c), '.') THEN replace(replace(c, '.', ''), ',', '.') ELSE replace(c, ',', '') END ELSE replace(c, ',', '.') END AS DECIMAL(38,10)) AS DECIMAL(28,4)) AS amount FROM f""", money=('amount',))
def n13(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, AMOUNTS).select("id", numbers.parse_stock_number(F.col("b")).cast("decimal(28,4)").alias("amount"))


@query("n14_numbers_in_text", f"WITH f AS ({plain(AMOUNTS)}), w AS (SELECT id, unnest(regexp_extract_all(concat('qty ', ip, ' at ', b, ' pcs'), '[-+]?[0-9]+(?:[.,][0-9]+)*')) AS s, generate_subscripts(regexp_extract_all(concat('qty ', ip, ' at ', b, ' pcs'), '[-+]?[0-9]+(?:[.,][0-9]+)*'), 1) AS place FROM (SELECT id, b, CAST(id AS STRING) AS ip FROM f) z) SELECT id, CAST(place AS INT) AS place, CAST({number_sql('s')} AS DECIMAL(28,4)) AS amount FROM w", money=('amount',))
def n14(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("qty "), F.col("id").cast("string"), F.lit(" at "), "b", F.lit(" pcs"))
    found = frame(spark, d, AMOUNTS).select("id", F.posexplode(numbers.numbers_in(text)).alias("place", "amount"))
    return found.select("id", (F.col("place") + 1).alias("place"), F.col("amount").cast("decimal(28,4)").alias("amount"))


@query("n15_number_lists_differ", "SELECT p_partkey AS id, p_size % 3 = 0 OR (p_size % 5 = 0) AS differs FROM part")
def n15(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.col(c).cast(numbers.NUMBER)
    a = F.array(number("p_partkey"), number("p_size"))
    longer = F.when(F.col("p_size") % 3 == 0, F.concat(a, F.array(number("p_size")))).otherwise(F.array(number("p_partkey"), F.when(F.col("p_size") % 5 == 0, number("p_size") + 1).otherwise(number("p_size"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbers.lists_differ(a, longer).alias("differs"))


@query("n18_distinctive_number", "SELECT p_partkey AS id, p_size >= 10 OR CAST(p_size AS DECIMAL(12,2)) / 4 <> floor(CAST(p_size AS DECIMAL(12,2)) / 4) AS whole_or_large FROM part WHERE p_size >= 0")
def n18(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("decimal(12,2)")
    return table(spark, d, "part").filter("p_size >= 0").select(F.col("p_partkey").alias("id"), (numbers.distinctive(size) | numbers.distinctive(size / 4)).alias("whole_or_large"))


@query("n20_vat_code", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '23' WHEN 1 THEN '8' WHEN 2 THEN 'zw' ELSE 'brak' END AS vat FROM part")
def n20(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 4 == 0, "23%").when(F.col("p_size") % 4 == 1, "8,0").when(F.col("p_size") % 4 == 2, " ZW ").otherwise("brak")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbers.vat_code(raw).alias("vat"))


@query("n21_truthy", "SELECT p_partkey AS id, CASE WHEN p_size % 4 IN (0, 1) THEN 1 ELSE 0 END AS sent FROM part")
def n21(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 4 == 0, "TAK").when(F.col("p_size") % 4 == 1, "yes ").when(F.col("p_size") % 4 == 2, "nie").otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbers.truthy(raw).alias("sent"))


@query("n22_roman_numeral", "SELECT p_partkey AS id, p_size % 10 AS value FROM part WHERE p_size % 10 > 0")
def n22(spark: SparkSession, d: str) -> DataFrame:
    ones = F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    parts = table(spark, d, "part").filter("p_size % 10 > 0")
    return parts.select(F.col("p_partkey").alias("id"), numbers.roman(F.get(ones, F.col("p_size") % 10 - 1)).alias("value"))


@query("n23_token_cost", "SELECT user_id, CAST(sum(CAST(CAST((CASE event_type WHEN 'view' THEN event_id % 1000 * 2.5 + event_id % 77 * 10 WHEN 'click' THEN event_id % 1000 * 0.25 + event_id % 77 * 1.25 ELSE event_id % 1000 * 3 + event_id % 77 * 15 END) AS DECIMAL(18,2)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS usd FROM events GROUP BY user_id", money=('usd',))
def n23(spark: SparkSession, d: str) -> DataFrame:
    cost = numbers.token_cost(F.col("event_type"), F.col("event_id") % 1000, F.col("event_id") % 77, {"view": (2.5, 10.0), "click": (0.25, 1.25)}, (3.0, 15.0))
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(cost).cast("decimal(18,6)").alias("usd"))


def _groups_sql(s: str, pattern: str, order: str) -> str:
    y, m, dd = (f"regexp_extract({s}, '{pattern}', {order.index(k) + 1})" for k in "ymd")
    date = f"TRY_CAST(CASE WHEN regexp_matches({s}, '{pattern}') THEN concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({dd}, 2, '0')) END AS DATE)"
    return f"CASE WHEN year({date}) BETWEEN 1990 AND 2100 THEN {date} END"


def date_sql(s: str) -> str:
    first, last = r"\b([0-9]{4})%s([0-9]{1,2})%s([0-9]{1,2})\b", r"\b([0-9]{1,2})%s([0-9]{1,2})%s([0-9]{4})\b"
    parts = [_groups_sql(s, first % (c, c), "ymd") for c in ("-", "/", r"\.")] + [_groups_sql(s, last % (r"\.", r"\."), "dmy")]
    for c in ("/", "-"):
        parts += [_groups_sql(s, last % (c, c), "dmy"), _groups_sql(s, last % (c, c), "mdy")]
    return f"coalesce({', '.join(parts)})"


def _candidates_sql(s: str) -> str:
    whole = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$"
    return f"list_sort(list_distinct(list_filter([{date_sql(s)}, {_groups_sql(s, whole, 'dmy')}, {_groups_sql(s, whole, 'mdy')}], lambda v: v IS NOT NULL)))"


_DATED = f"WITH f AS ({plain(DATES)}) "


@query("d01_normalize_date", _DATED + f"SELECT id, {date_sql('a')} AS d FROM f")
def d01(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, DATES).select("id", dates.parse_date(F.col("a")).alias("d"))


@query("d02_date_candidates", _DATED + f"SELECT id, unnest({_candidates_sql('a')}) AS d FROM f")
def d02(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, DATES).select("id", F.explode(dates.date_candidates(F.col("a"))).alias("d"))


@query("d03_dates_possibly_equal", _DATED + f"SELECT id, len(list_intersect({_candidates_sql('a')}, {_candidates_sql('b')})) > 0 AS possibly FROM f")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, DATES).select("id", dates.dates_possibly_equal(F.col("a"), F.col("b")).alias("possibly"))


_START = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
_START_DMY = r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})"


@query("d04_event_date", _DATED + f"SELECT id, coalesce({_groups_sql('a', _START, 'ymd')}, {_groups_sql('a', _START_DMY, 'dmy')}) AS d FROM f")
def d04(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, DATES).select("id", dates.parse_event_date(F.col("a")).alias("d"))


@query("d06_sortable_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM events")
def d06(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "d.M.yyyy HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "events").select("event_id", dates.sortable_time(raw).alias("t"))


@query("d07_gs1_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def d07(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.date_format("o_orderdate", "yyMM"), F.when(F.col("o_orderkey") % 4 == 0, "00").otherwise(F.date_format("o_orderdate", "dd")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.gs1_date(raw, F.lit("2024-02-01").cast("date")).alias("d"))


@query("d09_month_start", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1")
def d09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("d10_stamp_text", "SELECT o_orderkey AS id, concat_ws(' | ', 'COMPANY', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'MRN1' END, strftime(o_orderdate, '%d.%m.%Y')) AS text FROM orders")
def d10(spark: SparkSession, d: str) -> DataFrame:
    text = dates.stamp(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "MRN1").otherwise(""), F.lit("COMPANY"), F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))
