"""Derived tables: daily and monthly aggregates, wide feature tables, and their incremental forms.

Every wide table shrinks its children to one row a key before joining, so nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import joins, many_sources, refresh, windows
from starweave.plans.registry import Registry
from starweave.sources import snapshots
from starweave.sources.io import work_path

R = Registry()
q = R.query
C = F.col
DATE_BUCKETS = 64


def agg_daily(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Per day and kind: ordered, finished (by the order's day), and shipped lines (by their own day)."""
    # each source becomes rows of (day, kind, three counts), already summed per day, and one aggregation merges them
    o = M.add_date_keys(orders, [("date_key", "o_orderdate")]).groupBy("date_key", C("o_orderpriority").alias("kind"))
    placed = o.agg(F.count("*").alias("ordered"), F.count_if(C("o_orderstatus") == "F").alias("finished"), F.lit(0).cast("long").alias("shipped"))
    by_order = M.add_date_keys(lineitem.select("l_orderkey", "l_shipdate"), [("date_key", "l_shipdate")]).join(orders.select("o_orderkey", C("o_orderpriority").alias("kind")), C("l_orderkey") == C("o_orderkey"))
    shipped = by_order.groupBy("date_key", "kind").agg(F.lit(0).cast("long").alias("ordered"), F.lit(0).cast("long").alias("finished"), F.count("*").alias("shipped"))
    out = placed.unionByName(shipped).where("date_key IS NOT NULL").groupBy("date_key", "kind").agg(*(F.sum(c).cast("int").alias(c) for c in ("ordered", "finished", "shipped")))
    return out.withColumn("date_bucket", F.pmod("date_key", F.lit(DATE_BUCKETS)))


_DAILY = """SELECT coalesce(a.date_key, b.date_key, c.date_key) AS date_key, coalesce(a.kind, b.kind, c.kind) AS kind, coalesce(ordered, 0) AS ordered, coalesce(finished, 0) AS finished, coalesce(shipped, 0) AS shipped
 FROM (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, o_orderpriority AS kind, CAST(count(*) AS INTEGER) AS ordered FROM orders GROUP BY 1, 2) a
 FULL JOIN (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, o_orderpriority AS kind, CAST(count(*) AS INTEGER) AS finished FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) b ON a.date_key = b.date_key AND a.kind = b.kind
 FULL JOIN (SELECT CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS date_key, o_orderpriority AS kind, CAST(count(*) AS INTEGER) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) c
 ON coalesce(a.date_key, b.date_key) = c.date_key AND coalesce(a.kind, b.kind) = c.kind"""


@q("agg_daily", f"SELECT *, date_key % 64 AS date_bucket FROM ({_DAILY})")
def _(t):
    return agg_daily(t.orders, t.lineitem)


@q("agg_monthly", f"SELECT date_key // 100 AS year_month, kind, CAST(sum(ordered) AS BIGINT) AS ordered, CAST(sum(finished) AS BIGINT) AS finished, CAST(sum(shipped) AS BIGINT) AS shipped FROM ({_DAILY}) GROUP BY 1, 2")
def _(t):
    daily = agg_daily(t.orders, t.lineitem)
    return daily.groupBy(M.year_month("date_key").alias("year_month"), "kind").agg(*(F.sum(c).alias(c) for c in ("ordered", "finished", "shipped")))


def agg_balance(events: DataFrame) -> DataFrame:
    """Per day and user: what came in (purchases, not ingredients of others), what went out (errors), and the net."""
    e = M.add_date_keys(events, [("date_key", "ts")])
    total = lambda kind, n: e.where(F.lower("event_type") == kind).groupBy("date_key", "user_id").agg(F.sum("value").alias(n))
    out = joins.full_merge({"in": total("purchase", "intake"), "out": total("error", "output")}, ["date_key", "user_id"], ["intake", "output"])
    return out.select("date_key", "user_id", F.round("intake", 6).alias("intake"), F.round("output", 6).alias("output"), F.round(C("intake") - C("output"), 6).alias("net"))


@q("agg_balance", """SELECT coalesce(a.date_key, b.date_key) AS date_key, coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(i, 0), 6) AS intake, round(coalesce(o, 0), 6) AS output, round(coalesce(i, 0) - coalesce(o, 0), 6) AS net
 FROM (SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, user_id, sum(value) AS i FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) a FULL JOIN (SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, user_id, sum(value) AS o FROM events WHERE event_type = 'error' GROUP BY 1, 2) b ON a.date_key = b.date_key AND a.user_id = b.user_id""")
def _(t):
    return agg_balance(t.events)


def obt_encounter(orders: DataFrame, customer: DataFrame, lineitem: DataFrame, part: DataFrame, nation: DataFrame) -> DataFrame:
    """One row an order: subject context, detail counts and sums, first item, return rate, repeat measures."""
    base = windows.readmission(orders.withColumn("o_end", C("o_orderdate")), "o_custkey", "o_orderdate", "o_end", "o_orderkey").drop("o_end")
    base = joins.lookup(base, customer, "o_custkey", "c_custkey", ["c_mktsegment", "c_nationkey"])
    base = joins.lookup(base, nation, "c_nationkey", "n_nationkey", ["n_name"]).withColumnRenamed("o_orderkey", "k")
    back = C("l_returnflag") == "R"
    sized = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_discount", "l_shipdate").join(part.select("p_partkey", "p_size", "p_brand"), C("l_partkey") == C("p_partkey"), "left")
    # an order has few lines, so the set of its brands is small, and one shuffle by order does for all measures
    lines = (sized, "l_orderkey", [
        F.count("*").alias("line_count"), F.round(F.sum("l_quantity"), 6).alias("total_qty"), F.sum(back.cast("int")).alias("returned_count"), F.max("l_discount").alias("top_discount"),
        F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first_part"), F.min("l_shipdate").alias("first_ship"),
        F.size(F.collect_set("p_brand")).cast("long").alias("brand_count"), F.max("p_size").alias("top_size"),
    ])
    out = joins.star_rollup(base, {"lines": lines}, "k", {"line_count": 0, "total_qty": 0.0, "returned_count": 0, "brand_count": 0})
    return out.select(
        C("k").alias("o_orderkey"), "o_custkey", "c_mktsegment", "n_name", "o_orderstatus", "is_repeat", "gap_days", "line_count", "total_qty", "brand_count", "returned_count",
        "first_part", "top_size", "top_discount", F.round(M.share(C("returned_count"), C("line_count")), 8).alias("return_rate"), (C("line_count") > 0).alias("has_lines"),
        M.duration("o_orderdate", "first_ship", "day").alias("days_to_ship"), M.year_month(M.date_key("o_orderdate")).alias("order_year_month"),
    )


@q("obt_encounter", """WITH o AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
 l AS (SELECT l_orderkey, count(*) AS line_count, sum(l_quantity) AS total_qty, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned_count, max(l_discount) AS top_discount, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part, min(l_shipdate) AS first_ship, count(DISTINCT p_brand) AS brand_count, max(p_size) AS top_size
 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
 SELECT o_orderkey, o_custkey, c_mktsegment, n_name, o_orderstatus, prev IS NOT NULL AS is_repeat, CAST(trunc(date_sub('second', prev, o_orderdate) / 86400.0) AS INTEGER) AS gap_days, coalesce(line_count, 0) AS line_count, round(coalesce(total_qty, 0), 6) AS total_qty,
 coalesce(brand_count, 0) AS brand_count, coalesce(returned_count, 0) AS returned_count, first_part, top_size, top_discount, round(CAST(returned_count AS DOUBLE) / line_count, 8) AS return_rate, coalesce(line_count, 0) > 0 AS has_lines,
 date_sub('second', o_orderdate, first_ship) / 86400.0 AS days_to_ship, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS order_year_month
 FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON l_orderkey = o_orderkey""")
def _(t):
    return obt_encounter(t.orders, t.customer, t.lineitem, t.part, t.nation)


@q("obt_incremental", "SELECT o_custkey, CAST(strftime(min(o_orderdate), '%Y%m') AS INTEGER) AS first_month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    # changed details touch orders, orders touch customers; whole first-order months are recomputed, the rest is carried
    def build(rows):
        out = rows.groupBy("o_custkey").agg(M.year_month(M.date_key(F.min("o_orderdate"))).alias("first_month"), F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return out

    old = build(t.orders.where("o_orderkey % 50 <> 7"))  # the target as it was written
    touched = refresh.touched_keys([(t.orders.where("o_orderkey % 50 = 7"), "o_custkey")], "o_custkey")
    now = build(t.orders.join(touched, "o_custkey", "left_semi"))
    months = now.select("first_month").union(old.join(touched, "o_custkey", "left_semi").select("first_month")).distinct()
    members = old.join(months, "first_month", "left_semi").select("o_custkey").union(touched).distinct()
    new = build(t.orders.join(members, "o_custkey", "left_semi"))
    return new.unionByName(old.join(members, "o_custkey", "left_anti"))


@q("obt_subject", """SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, first_order, last_order, coalesce(distinct_parts, 0) AS distinct_parts, coalesce(ever_finished, false) AS ever_finished, round(coalesce(total, 0), 2) AS total
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order, bool_or(o_orderstatus = 'F') AS ever_finished, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey AS k, count(DISTINCT l_partkey) AS distinct_parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey""")
def _(t):
    details = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    children = {
        "orders": (t.orders, "o_custkey", [F.count("*").alias("n_orders"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"), (F.max(F.when(C("o_orderstatus") == "F", 1).otherwise(0)) == 1).alias("ever_finished"), F.sum("o_totalprice").alias("total")]),
        "details": (details, "o_custkey", [F.count_distinct("l_partkey").alias("distinct_parts")]),
    }
    out = joins.star_rollup(t.customer, children, "c_custkey", {"n_orders": 0, "distinct_parts": 0, "ever_finished": False, "total": 0.0})
    return out.select("c_custkey", "c_mktsegment", "n_orders", "first_order", "last_order", "distinct_parts", "ever_finished", F.round("total", 2).alias("total"))


def subject_totals(orders: DataFrame, customer: DataFrame, lineitem: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per customer, kept by nation: orders, their value, and the lines of these orders. only: the customers to build."""
    among = lambda df, key: df if only is None else df.join(only.select(C("c_custkey").alias(key)), key, "left_semi")
    own = among(orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey")
    lines = lineitem.select("l_orderkey", "l_quantity").join(own.select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    children = {
        "orders": (own, "o_custkey", [F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")]),
        "lines": (lines, "o_custkey", [F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")]),
    }
    base = among(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    return joins.star_rollup(base, children, "c_custkey", {"n_orders": 0, "total": 0.0, "n_lines": 0, "quantity": 0.0})


@q("refresh_many_sources", """SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, round(coalesce(total, 0), 2) AS total, coalesce(n_lines, 0) AS n_lines, round(coalesce(quantity, 0), 2) AS quantity FROM customer
 LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON k = c_custkey
 LEFT JOIN (SELECT o_custkey AS j, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON j = c_custkey""")
def _(t):
    # yesterday's tables: some orders and lines were not there, and some customers lived in another nation
    stamp = lambda late: F.when(late, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp")
    orders, lineitem = t.orders.withColumn("updated_ts", stamp(C("o_orderkey") % 500 == 7)), t.lineitem.withColumn("updated_ts", stamp((C("l_orderkey") % 300 == 5) & (C("l_linenumber") == 1)))
    customer = t.customer.withColumn("updated_ts", stamp(C("c_custkey") % 400 == 3))
    before = lambda df: df.where("updated_ts < '2024-01-02'")
    moved = customer.withColumn("c_nationkey", F.when(C("updated_ts") >= "2024-01-02", (C("c_nationkey") + 1) % 25).otherwise(C("c_nationkey"))).withColumn("updated_ts", F.lit("2024-01-01").cast("timestamp"))
    spark, path = orders.sparkSession, work_path(orders.sparkSession, "subject-totals")

    def run(o, c, i):
        of_order = lambda d: o.join(d.select(C("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").select("o_custkey")
        sources = {"orders": many_sources.by_column(o, "o_custkey"), "customer": many_sources.by_column(c, "c_custkey"), "lineitem": many_sources.Source(i, of_order)}
        return many_sources.refresh_many(spark, path, sources, c, "c_custkey", "c_nationkey", lambda only: subject_totals(o, c, i, only))

    run(before(orders), moved, before(lineitem))
    run(orders, customer, lineitem)
    return snapshots.read(spark, path)


@q("obt_window", """SELECT user_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS n_readings, CAST(count_if(value > 150) AS BIGINT) AS abnormal, round(CAST(count_if(value > 150) AS DOUBLE) / count(*), 8) AS abnormal_rate, round(sum(value), 6) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def _(t):
    e = M.add_date_keys(t.events, [("date_key", "ts")])
    high = C("value") > 150
    return e.groupBy("user_id", "date_key").agg(
        F.count("*").alias("n_readings"), F.count_if(high).alias("abnormal"), F.round(M.share(F.count_if(high), F.count("*")), 8).alias("abnormal_rate"), F.round(F.sum("value"), 6).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
