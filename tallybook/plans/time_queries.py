"""Queries over time: windows, states, clocks, limits and streams (W, R, A18, S09)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import linkage, storage, timing
from ..streaming import limits
from .registry import query, table

#: Statuses that stand for the kinds of events.
_STATUSES = {"signup": "utworzone", "view": "proforma_oczekiwana", "click": "etd_sap", "purchase": "rozliczenie_fiori", "error": "rozliczone"}


def _status() -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in _STATUSES.items() for x in p)), "event_type")


@query("w01_top_revisions", "SELECT source, doc_id, r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r <= 50")
def w01(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), F.desc("doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("r")).filter("r <= 50")


@query("w02_pick_level", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, n_chars DESC, doc_id DESC) AS r FROM documents WHERE lang <> 'es') WHERE r = 1")
def w02(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    docs = table(spark, d, "documents").filter("lang <> 'es'").select("source", "doc_id", "n_chars", "lang")
    return linkage.latest(docs, ["source"], [tier, F.desc("n_chars"), F.desc("doc_id")]).select("source", "doc_id")


_CLOCK = "SELECT l_suppkey % 50 AS container, CAST(min(l_shipdate) AS DATE) AS start, CASE WHEN l_suppkey % 50 % 4 = 0 THEN NULL ELSE CAST(min(l_shipdate) AS DATE) + CAST(l_suppkey % 50 AS INT) END AS stop FROM lineitem GROUP BY l_suppkey % 50"
_TODAY = "DATE '1995-01-20'"


@query("w04_free_time", f"""WITH c AS ({_CLOCK}), u AS (SELECT container, stop IS NULL AS is_open, greatest(0, date_diff('day', start, coalesce(stop, {_TODAY}))) AS used FROM c), o AS (SELECT *, greatest(0, used - 14) AS over, greatest(0, 14 - used) AS left_days FROM u)
  SELECT container, used, over AS over_days, left_days, CASE WHEN over > 0 OR (is_open AND left_days = 0) THEN 'red' WHEN is_open AND left_days <= 3 THEN 'amber' ELSE 'green' END AS level, over * 12.5 AS cost FROM o""", money=("cost",))
def w04(spark: SparkSession, d: str) -> DataFrame:
    c = _clocks(spark, d).withColumn("t", timing.free_time(F.col("start"), F.col("stop"), 14, 3, 12.5, F.lit("1995-01-20").cast("date")))
    return c.select("container", F.col("t.used").alias("used"), F.col("t.over").alias("over_days"), F.col("t.left").alias("left_days"), F.col("t.level").alias("level"), F.col("t.cost").alias("cost"))


def _clocks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_suppkey") % 50
    first = table(spark, d, "lineitem").groupBy(c.alias("container")).agg(F.min("l_shipdate").cast("date").alias("start"))
    return first.withColumn("stop", F.when(F.col("container") % 4 != 0, F.date_add("start", F.col("container").cast("int"))))


@query("w05_container_level", f"WITH c AS ({_CLOCK}), u AS (SELECT container, stop IS NULL AS is_open, greatest(0, date_diff('day', start, coalesce(stop, {_TODAY}))) AS used FROM c), l AS (SELECT container, CASE WHEN used > 14 OR (is_open AND used >= 14) THEN 2 WHEN is_open AND used >= 11 THEN 1 ELSE 0 END AS a, CASE WHEN used > 7 OR (is_open AND used >= 7) THEN 2 WHEN is_open AND used >= 4 THEN 1 ELSE 0 END AS b, greatest(0, used - 14) * 10 + greatest(0, used - 7) * 5 AS total FROM u) SELECT container, CASE greatest(a, b) WHEN 2 THEN 'red' WHEN 1 THEN 'amber' ELSE 'green' END AS level, total FROM l", money=("total",))
def w05(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit("1995-01-20").cast("date")
    c = _clocks(spark, d).select("container", timing.free_time(F.col("start"), F.col("stop"), 14, 3, 10.0, today).alias("a"), timing.free_time(F.col("start"), F.col("stop"), 7, 3, 5.0, today).alias("b"))
    return c.select("container", timing.worst(F.col("a.level"), F.col("b.level")).alias("level"), (F.col("a.cost") + F.col("b.cost")).alias("total"))


@query("w06_overdue", "SELECT event_id, CASE event_type WHEN 'view' THEN event_id % 16 >= 7 WHEN 'click' THEN event_id % 16 >= 3 WHEN 'purchase' THEN event_id % 16 >= 14 ELSE false END AS overdue FROM events")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", timing.overdue(_status(), F.col("event_id") % 16).alias("overdue"))


@query("w07_steps", "SELECT event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 2 WHEN 'click' THEN 7 WHEN 'purchase' THEN 18 ELSE 19 END AS step, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 3 ELSE 7 END AS phase, CASE event_type WHEN 'signup' THEN 'wyslane_do_dostawcy' WHEN 'view' THEN 'proforma_otrzymana' WHEN 'click' THEN 'zlecenie_spedycja' WHEN 'purchase' THEN 'rozliczenie_transportu' END AS next FROM events")
def w07(spark: SparkSession, d: str) -> DataFrame:
    s = _status()
    return table(spark, d, "events").select("event_id", timing.step_index(s).alias("step"), timing.phase_index(s).alias("phase"), timing.next_step(s).alias("next"))


@query("w11_upcoming", "SELECT o_orderkey, arrival FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 7 END, CAST(o_orderdate AS DATE) + 14) AS arrival FROM orders WHERE o_orderstatus <> 'F') WHERE arrival BETWEEN DATE '1997-01-01' - 3 AND DATE '1997-01-01' + 30")
def w11(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    arrival = F.coalesce(F.when(k % 3 == 0, day), F.when(k % 2 == 0, F.date_add(day, 7)), F.date_add(day, 14))
    today = F.lit("1997-01-01").cast("date")
    rows = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", arrival.alias("arrival"))
    return rows.filter(F.col("arrival").between(F.date_add(today, -3), F.date_add(today, 30))).orderBy("arrival", "o_orderkey")


@query("w14_forward_fill", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events")
def w14(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("mark"))
    return timing.filled_forward(e, ["user_id"], ["ts", "event_id"], "mark", "since").select("user_id", "event_id", "since")


@query("w15_running_total_choice", "SELECT doc, arg_max(v, struct_pack(p := p, v := v)) AS total FROM (SELECT l_orderkey AS doc, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS p FROM lineitem) GROUP BY doc", money=("total",))
def w15(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    best = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.max(F.struct(p.alias("p"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))).alias("m"))
    return best.select("doc", F.col("m.v").alias("total"))


@query("a18_gap_clusters", "WITH f AS (SELECT s_nationkey, s_acctbal, CASE WHEN CAST(s_acctbal AS DECIMAL(18,2)) - lag(CAST(s_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal AS DECIMAL(18,2))) > 500 THEN 1 ELSE 0 END AS fresh FROM supplier), i AS (SELECT s_nationkey, s_acctbal, sum(fresh) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS island FROM f) SELECT s_nationkey, CAST(island AS BIGINT) AS island, count(*) AS n, min(s_acctbal) AS low, max(s_acctbal) AS high FROM i GROUP BY 1, 2")
def a18(spark: SparkSession, d: str) -> DataFrame:
    rows = timing.islands(table(spark, d, "supplier").withColumn("b", F.col("s_acctbal").cast("decimal(18,2)")), ["s_nationkey"], "b", 500)
    return rows.groupBy("s_nationkey", "island").agg(F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))


@query("s09_page_groups", "WITH p AS (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN NULL ELSE role END AS kind FROM conversations), s AS (SELECT *, CASE WHEN kind IS NOT NULL AND kind IS DISTINCT FROM last_value(kind IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS st FROM p), g AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM s) SELECT conv_id, max(kind) AS kind, min(turn) AS first, max(turn) AS last FROM g GROUP BY conv_id, grp")
def s09(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pages = table(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("kind", F.when(~F.col("role").eqNullSafe(F.lag("role").over(w)), F.col("role")))
    return timing.page_groups(pages, ["conv_id"], "turn", "kind")


_LIMIT = "SELECT user_id, event_id, recent FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = '{k}') WHERE recent >= {n}"


@query("r01_rate_limit", _LIMIT.format(s=86399.999999, k="error", n=2).replace("INTERVAL 86399.999999 SECOND", "INTERVAL 86399999999 MICROSECOND"))
def r01(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts")
    return timing.recent_count(e, "user_id", "ts", 86_400).filter("recent >= 2").select("user_id", "event_id", "recent")


@query("r02_request_limit", _LIMIT.format(s=1, k="click", n=3).replace("INTERVAL 1 SECOND", "INTERVAL 172799999999 MICROSECOND"))
def r02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'click'").select("user_id", "event_id", "ts")
    return timing.recent_count(e, "user_id", "ts", 172_800).filter("recent >= 3").select("user_id", "event_id", "recent")


@query("r09_state_durations", "SELECT event_type, count(*) AS n, CAST(sum(date_diff('second', date_trunc('second', ts), date_trunc('second', nxt))) AS BIGINT) AS seconds FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY event_type")
def r09(spark: SparkSession, d: str) -> DataFrame:
    e = timing.state_durations(table(spark, d, "events"), "user_id", "ts", ["event_id"]).filter("until is not null")
    seconds = F.unix_timestamp(F.col("until").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds"))


@query("r10_last_write_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def r10(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return best.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("event_type"))


def _checkpoint(spark: SparkSession) -> str:
    return storage.new_folder(spark, "stream")


@query("r01_stream_rate_limit", "SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS w FROM events WHERE event_type = 'error') GROUP BY user_id, w")
def r01_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = limits.windowed_counts(limits.event_stream(spark, f"{d}/events.parquet"), "user_id", "error", lateness="3650 days")
    found = limits.drained(stream, spark, _checkpoint(spark), "update")
    last = found.groupBy("user_id", "w").agg(F.max("n").alias("n"))
    return last.select("user_id", F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("r10_stream_once_each", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def r10_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = limits.once_each(limits.event_stream(spark, f"{d}/events.parquet").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "3650 days")
    return limits.drained(stream, spark, _checkpoint(spark)).agg(F.count(F.lit(1)).alias("n"))


@query("r09_stream_closed_states", "SELECT event_type AS state, count(*) AS n, CAST(sum(epoch_us(nxt) - epoch_us(ts)) AS BIGINT) AS micros FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY event_type")
def r09_stream(spark: SparkSession, d: str) -> DataFrame:
    closed = limits.drained(limits.closed_states(limits.event_stream(spark, f"{d}/events.parquet"), "user_id"), spark, _checkpoint(spark))
    return closed.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("until") - F.col("begin")).alias("micros"))
