"""Workflow queries: cohorts, rankings, as-of values, turnaround, reconciliation and cross-modal questions on the star tables.

Roles: customer is the subject, orders the encounter, lineitem its details, part the item dimension, events the readings,
documents and conversations the notes, labels their coded side.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import arrays, joins, quantiles, text, windows
from starweave.plans.operator_queries import tag_sql
from starweave.plans.registry import Registry
from starweave.sources.io import staged

R = Registry()
q = R.query
C = F.col


def _dbl(x):
    return x.cast("double")


@q("Q01", """SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS qtr, o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def _(t):
    rows = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"))
    return rows.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("qtr"), "o_orderpriority", "c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    ).orderBy("y", "qtr", F.desc("n"), "o_orderpriority", "c_mktsegment")


@q("Q02", """SELECT o_orderpriority, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS finished, round(100.0 * CAST(count_if(o_orderstatus = 'F') AS DOUBLE) / count(*), 2) AS pct,
 round(quantile_cont(o_totalprice, 0.5), 4) AS median_price, round(quantile_cont(o_totalprice, 0.9), 4) AS p90_price, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mean_finished FROM orders GROUP BY 1""")
def _(t):
    done = C("o_orderstatus") == "F"
    aggs = [F.count_if(done).alias("finished"), M.percent(done).alias("pct"), F.round(F.avg(F.when(done, C("o_totalprice"))), 4).alias("mean_finished")]
    return quantiles.grouped(t.orders, ["o_orderpriority"], aggs, {"median_price": ("o_totalprice", 0.5), "p90_price": ("o_totalprice", 0.9)}, 4)


#: Compaction in a sketch is random: three times the bound that one quantile keeps with 99 % confidence is kept by all groups.
_K = 200
_BOUND = 3 * quantiles.rank_error(_K)


def _in_bound(rows, by, column, sketch):
    """Per group: n, and whether the exact ranks of the sketch's median and ninth decile are within the stated bound."""
    marks = sketch.select(*(C(b).alias(f"_{b}") for b in by), *(quantiles.quantile("sketch", p).alias(f"_q{i}") for i, p in enumerate((0.5, 0.9))))
    on = F.lit(True)
    for b in by:
        on = on & C(b).eqNullSafe(C(f"_{b}"))
    ok = lambda i, p: (F.avg((C(column) < C(f"_q{i}")).cast("double")) <= p + _BOUND) & (F.avg((C(column) <= C(f"_q{i}")).cast("double")) >= p - _BOUND)
    return rows.where(C(column).isNotNull()).join(marks, on).groupBy(*by).agg(F.count("*").alias("n"), ok(0, 0.5).alias("median_in_bound"), ok(1, 0.9).alias("p90_in_bound"))


@q("Q02_approx", "SELECT o_orderpriority, count(*) AS n, TRUE AS median_in_bound, TRUE AS p90_in_bound FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def _(t):
    sketch = quantiles.sketches(t.orders, ["o_orderpriority"], "o_totalprice", "sketch", _K)
    return _in_bound(t.orders, ["o_orderpriority"], "o_totalprice", sketch)


@q("percentile_rollup", "SELECT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS year_month, o_orderpriority, count(*) AS n, TRUE AS median_in_bound, TRUE AS p90_in_bound FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2")
def _(t):
    # sketches of the daily aggregate are stored with it, and months come from them alone
    orders = t.orders.select(M.date_key("o_orderdate").alias("date_key"), "o_orderpriority", "o_totalprice").withColumn("year_month", M.year_month("date_key"))
    daily = staged(quantiles.sketches(orders, ["date_key", "o_orderpriority"], "o_totalprice", "sketch", _K), "daily-sketches")
    monthly = quantiles.merged(daily, [M.year_month("date_key").alias("year_month"), "o_orderpriority"], "sketch", _K)
    return _in_bound(orders, ["year_month", "o_orderpriority"], "o_totalprice", monthly)


@q("Q13_selected", """SELECT p_brand, o_orderpriority, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _(t):
    # whatever the size of the tables: written once, then selected
    rows = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.part, C("l_partkey") == C("p_partkey")).select("p_brand", "o_orderpriority", "l_extendedprice")
    return quantiles.grouped(rows, ["p_brand", "o_orderpriority"], [F.count("*").alias("n")], {"median_price": ("l_extendedprice", 0.5), "p90_price": ("l_extendedprice", 0.9)}, 4, small_bytes=0)


@q("percentile_exact", """SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY 1""")
def _(t):
    # brackets of few values, so that several rounds are needed
    ranks = quantiles.exact(t.events, ["event_type"], {"p01": ("value", 0.01), "p50": ("value", 0.5), "p999": ("value", 0.999)}, few=256, accuracy=400, written=True)
    return ranks.select("event_type", *(F.round(c, 6).alias(c) for c in ("p01", "p50", "p999")))


@q("Q03", """SELECT prior, o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders)
 WHERE prior IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, prior, o_orderpriority LIMIT 20""")
def _(t):
    rows = windows.prior(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", "prior").where("prior IS NOT NULL")
    return rows.groupBy("prior", "o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prior", "o_orderpriority").limit(20)


@q("Q04", """SELECT l_linestatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN
 (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1) ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _(t):
    last = windows.latest_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey")])
    rows = t.orders.join(last, C("l_orderkey") == C("o_orderkey"))
    return rows.groupBy("l_linestatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@q("Q05", """SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 25""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(25)


@q("Q06", """WITH c AS (SELECT DISTINCT l_orderkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE '%STEEL' THEN 'steel' END AS cohort FROM lineitem JOIN part ON l_partkey = p_partkey),
 o AS (SELECT o_orderkey, date_sub('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS gap FROM orders)
 SELECT cohort, count(*) AS n, CAST(sum(CASE WHEN gap <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM c JOIN o ON l_orderkey = o_orderkey WHERE cohort IS NOT NULL GROUP BY 1""")
def _(t):
    p = C("p_type")
    cohort = F.when(p.like("STANDARD%"), "standard").when(p.like("PROMO%"), "promo").when(p.like("%STEEL"), "steel")
    c = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).select("l_orderkey", cohort.alias("cohort")).distinct().where("cohort IS NOT NULL")
    o = windows.following(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "nx").select("o_orderkey", M.whole_days("o_orderdate", "nx").alias("gap"))
    return c.join(o, C("l_orderkey") == C("o_orderkey")).groupBy("cohort").agg(F.count("*").alias("n"), F.sum(F.when(C("gap") <= 30, 1).otherwise(0)).alias("returned"))


_BAND = "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END"


@q("Q07", f"SELECT {_BAND} AS size_band, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty, max(l_extendedprice) AS top FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey"))
    return rows.groupBy(M.band("p_size", [(10, "small"), (30, "mid")], "large").alias("size_band"), "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.max("l_extendedprice").alias("top"))


@q("Q08", """WITH d AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT avg(o_totalprice) AS overall FROM orders)
 SELECT p_brand, count(*) AS n, round(avg(o_totalprice) - any_value(overall), 4) AS delta FROM d JOIN orders ON l_orderkey = o_orderkey CROSS JOIN m GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 25""")
def _(t):
    d = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).select("l_orderkey", "p_brand").distinct()
    overall = t.orders.agg(F.avg("o_totalprice").alias("overall"))  # one row
    rows = d.join(t.orders, C("l_orderkey") == C("o_orderkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return rows.join(F.broadcast(overall)).select("p_brand", "n", F.round(C("mean") - C("overall"), 4).alias("delta")).orderBy(F.desc("n"), "p_brand").limit(25)


_BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
_FLAGS = ", ".join(f"max(CASE WHEN regexp_matches(p_brand, '^{b}') THEN 1 ELSE 0 END) AS f{i}" for i, b in enumerate(_BRANDS))


@q("Q09", f"""WITH f AS (SELECT l_orderkey, {_FLAGS} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), s AS (SELECT l_orderkey, f0 + 2 * f1 + 3 * f2 + f3 + 2 * f4 AS score FROM f)
 SELECT CASE WHEN score < 2 THEN '0-1' WHEN score < 4 THEN '2-3' WHEN score < 6 THEN '4-5' ELSE '6+' END AS score_band, count(*) AS n, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS finished FROM s JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    flags = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).groupBy("l_orderkey").agg(*(M.flag_any(C("p_brand").rlike(f"^{b}")).alias(f"f{i}") for i, b in enumerate(_BRANDS)))
    s = flags.select("l_orderkey", (C("f0") + 2 * C("f1") + 3 * C("f2") + C("f3") + 2 * C("f4")).alias("score"))
    return s.join(t.orders, C("l_orderkey") == C("o_orderkey")).groupBy(M.band("score", [(2, "0-1"), (4, "2-3"), (6, "4-5")], "6+").alias("score_band")).agg(F.count("*").alias("n"), F.count_if(C("o_orderstatus") == "F").alias("finished"))


@q("Q10", """SELECT o_custkey, any_value(c_name) AS c_name, CAST(sum(parts) AS BIGINT) AS parts, max(kinds) AS most_kinds FROM (SELECT l_orderkey, count(*) AS parts, count(DISTINCT l_partkey) AS kinds FROM lineitem GROUP BY 1)
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY parts DESC, o_custkey LIMIT 25""")
def _(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.count_distinct("l_partkey").alias("kinds"))
    rows = per.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey"))
    return rows.groupBy("o_custkey").agg(F.min("c_name").alias("c_name"), F.sum("parts").alias("parts"), F.max("kinds").alias("most_kinds")).orderBy(F.desc("parts"), "o_custkey").limit(25)


@q("Q11", """WITH e AS (SELECT user_id, arg_min(value, (ts, event_id)) AS base, max(value) AS peak FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT DISTINCT user_id, 1 AS bought FROM events WHERE event_type = 'purchase' AND value > 150),
 s AS (SELECT CASE WHEN peak >= 3 * base THEN 3 WHEN peak >= 2 * base THEN 2 WHEN peak >= 1.5 * base THEN 1 ELSE 0 END AS stage, coalesce(bought, 0) AS bought FROM e LEFT JOIN b USING (user_id))
 SELECT stage, count(*) AS n, CAST(sum(bought) AS BIGINT) AS bought FROM s GROUP BY 1""")
def _(t):
    v = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("base"), F.max("value").alias("peak"))
    b = t.events.where("event_type = 'purchase' AND value > 150").select("user_id", F.lit(1).alias("bought")).distinct()
    stage = F.when(C("peak") >= 3 * C("base"), 3).when(C("peak") >= 2 * C("base"), 2).when(C("peak") >= 1.5 * C("base"), 1).otherwise(0)
    return v.join(b, "user_id", "left").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.sum(F.coalesce("bought", F.lit(0))).alias("bought"))


@q("Q12", """WITH u AS (SELECT user_id, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, CAST(count_if(event_type = 'purchase') AS BIGINT) AS purchases FROM events GROUP BY 1)
 SELECT quarter, count(*) AS n, min(errors) AS least, max(errors) AS most, CAST(sum(purchases) AS BIGINT) AS purchases FROM (SELECT *, CAST(ntile(4) OVER (ORDER BY errors, user_id) AS INTEGER) AS quarter FROM u) GROUP BY 1""")
def _(t):
    u = t.events.groupBy("user_id").agg(F.count_if(C("event_type") == "error").alias("errors"), F.count_if(C("event_type") == "purchase").alias("purchases"))
    return windows.quartile(u, "errors", "user_id", "quarter").groupBy("quarter").agg(F.count("*").alias("n"), F.min("errors").alias("least"), F.max("errors").alias("most"), F.sum("purchases").alias("purchases"))


@q("Q13", """SELECT p_brand, o_orderpriority, count(*) AS n, round(quantile_cont(mins, 0.5), 4) AS median_min, round(quantile_cont(mins, 0.9), 4) AS p90_min, round(100.0 * CAST(count_if(mins <= 43200) AS DOUBLE) / count(*), 2) AS in_month
 FROM (SELECT p_brand, coalesce(o_orderpriority, 'none') AS o_orderpriority, date_sub('second', o_orderdate, l_shipdate) / 60.0 AS mins FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WHERE mins >= 0 GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    rows = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.part, C("l_partkey") == C("p_partkey"))
    rows = rows.select("p_brand", F.coalesce("o_orderpriority", F.lit("none")).alias("o_orderpriority"), M.duration("o_orderdate", "l_shipdate", "minute").alias("mins")).where("mins >= 0")
    aggs = [F.count("*").alias("n"), M.percent(C("mins") <= 43200).alias("in_month")]
    return quantiles.grouped(rows, ["p_brand", "o_orderpriority"], aggs, {"median_min": ("mins", 0.5), "p90_min": ("mins", 0.9)}, 4).where("n >= 20")


@q("Q14", """WITH a AS (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1), f AS (SELECT a.user_id, s, min(ts) AS p, max(CASE WHEN strpos(props, '1') > 0 THEN 1 ELSE 0 END) AS concordant FROM a LEFT JOIN events e ON e.user_id = a.user_id AND e.event_type = 'purchase' AND e.ts >= s GROUP BY 1, 2)
 SELECT CASE WHEN p IS NULL THEN 'never' WHEN date_sub('second', s, p) / 3600.0 < 6 THEN '<6h' WHEN date_sub('second', s, p) / 3600.0 < 24 THEN '<1d' ELSE '1d+' END AS delay, count(*) AS n, CAST(sum(concordant) AS BIGINT) AS concordant FROM f GROUP BY 1""")
def _(t):
    a = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("s"))
    e = t.events.where("event_type = 'purchase'").select(C("user_id").alias("u"), "ts", "props")
    f = a.join(e, (C("user_id") == C("u")) & (C("ts") >= C("s")), "left").groupBy("user_id", "s").agg(F.min("ts").alias("p"), M.flag_any(F.instr("props", "1") > 0).alias("concordant"))
    hours = M.duration("s", "p", "hour")
    delay = F.when(C("p").isNull(), "never").when(hours < 6, "<6h").when(hours < 24, "<1d").otherwise("1d+")
    return f.groupBy(delay.alias("delay")).agg(F.count("*").alias("n"), F.sum("concordant").alias("concordant"))


@q("Q15", """SELECT p_brand, p_type, count(*) AS n, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned, round(100.0 * CAST(count_if(l_returnflag = 'R') AS DOUBLE) / count(*), 2) AS pct
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'N', 'A') AND trim(p_brand) <> '' GROUP BY 1, 2 HAVING count(*) >= 30 ORDER BY pct DESC, n DESC, p_brand, p_type LIMIT 50""")
def _(t):
    rows = t.lineitem.where(C("l_returnflag").isin("R", "N", "A")).join(t.part.where(M.present("p_brand")), C("l_partkey") == C("p_partkey"))
    back = C("l_returnflag") == "R"
    return rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_if(back).alias("returned"), M.percent(back).alias("pct")).where("n >= 30").orderBy(F.desc("pct"), F.desc("n"), "p_brand", "p_type").limit(50)


@q("Q16", """WITH g AS (SELECT o_custkey, o_totalprice, date_sub('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders),
 c AS (SELECT o_custkey, quantile_cont(gap, 0.5) AS median_gap, max(o_totalprice) AS top FROM g WHERE gap IS NOT NULL GROUP BY 1)
 SELECT quarter, count(*) AS n, round(avg(median_gap), 6) AS mean_gap, round(avg(top), 4) AS mean_top FROM (SELECT *, CAST(ntile(4) OVER (ORDER BY median_gap, o_custkey) AS INTEGER) AS quarter FROM c) GROUP BY 1""")
def _(t):
    g = windows.prior(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "pr").select("o_custkey", "o_totalprice", M.whole_days("pr", "o_orderdate").alias("gap")).where("gap IS NOT NULL")
    c = g.groupBy("o_custkey").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("o_totalprice").alias("top"))
    return windows.quartile(c, "median_gap", "o_custkey", "quarter").groupBy("quarter").agg(F.count("*").alias("n"), F.round(F.avg("median_gap"), 6).alias("mean_gap"), F.round(F.avg("top"), 4).alias("mean_top"))


_EXPO = "CASE WHEN regexp_matches(lower(k), 'steel') THEN 'steel' WHEN regexp_matches(lower(k), 'brass|copper') THEN 'alloy' ELSE 'other' END"


@q("Q17", f"""WITH u AS (SELECT l_orderkey, p_type AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O')
 SELECT exposure, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders FROM (SELECT l_orderkey, {_EXPO} AS exposure FROM u) GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey"))
    u = rows.where("l_returnflag = 'R'").select("l_orderkey", C("p_type").alias("k")).union(rows.where("l_linestatus = 'O'").select("l_orderkey", "p_name"))
    return u.groupBy(M.first_match(F.lower("k"), [("steel", "steel"), ("alloy", "brass|copper")], "other").alias("exposure")).agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


@q("Q18", """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 45) GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    bad = t.orders.join(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45"), C("l_orderkey") == C("o_orderkey")).select(C("o_custkey").alias("k"))
    some = t.customer.join(t.orders.select("o_custkey"), C("c_custkey") == C("o_custkey"), "left_semi")
    return some.join(bad, C("c_custkey") == C("k"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")).where("n >= 2")


@q("Q19", """WITH s AS (SELECT user_id, event_type, lag(event_type) OVER w AS prev, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 u AS (SELECT user_id, CAST(count_if(prev <> event_type) AS BIGINT) AS moves, CAST(count_if(prev <> event_type AND before > 0) AS BIGINT) AS returns FROM s GROUP BY 1)
 SELECT CASE WHEN moves < 40 THEN 'few' WHEN moves < 60 THEN 'some' ELSE 'many' END AS moves_band, count(*) AS n, CAST(sum(returns) AS BIGINT) AS returns FROM u GROUP BY 1""")
def _(t):
    s = windows.prior_visits(windows.prior(t.events, ["user_id"], ["ts", "event_id"], "event_type", "prev"), ["user_id"], "event_type", ["ts", "event_id"], "before")
    moved = C("prev") != C("event_type")
    u = s.groupBy("user_id").agg(F.count_if(moved).alias("moves"), F.count_if(moved & (C("before") > 0)).alias("returns"))
    return u.groupBy(M.band("moves", [(40, "few"), (60, "some")], "many").alias("moves_band")).agg(F.count("*").alias("n"), F.sum("returns").alias("returns"))


@q("Q20", """WITH s AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events), f AS (SELECT user_id, max(CASE WHEN event_type = 'view' AND nx = 'purchase' THEN 1 ELSE 0 END) AS direct, max(CASE WHEN event_type = 'error' AND nx = 'error' THEN 1 ELSE 0 END) AS stuck FROM s GROUP BY 1)
 SELECT CASE WHEN direct = 1 AND stuck = 1 THEN 'both' WHEN direct = 1 THEN 'direct' WHEN stuck = 1 THEN 'stuck' ELSE 'none' END AS kind, count(*) AS n FROM f GROUP BY 1""")
def _(t):
    s = windows.following(t.events, ["user_id"], ["ts", "event_id"], "event_type", "nx")
    f = s.groupBy("user_id").agg(M.flag_any((C("event_type") == "view") & (C("nx") == "purchase")).alias("d"), M.flag_any((C("event_type") == "error") & (C("nx") == "error")).alias("s"))
    kind = F.when((C("d") == 1) & (C("s") == 1), "both").when(C("d") == 1, "direct").when(C("s") == 1, "stuck").otherwise("none")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@q("Q21", """WITH a AS (SELECT a.o_orderkey, arg_max(b.o_totalprice, (b.o_orderdate, b.o_orderkey)) AS v FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY WHERE b.o_totalprice BETWEEN 1000 AND 500000 GROUP BY 1)
 SELECT CASE WHEN v < 50000 THEN 'low' WHEN v < 150000 THEN 'mid' ELSE 'high' END AS last_band, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM a JOIN orders USING (o_orderkey) GROUP BY 1""")
def _(t):
    facts = t.orders.where(C("o_totalprice").between(1000, 500000)).select("o_custkey", C("o_orderdate").alias("d"), C("o_totalprice").alias("v"), C("o_orderkey").alias("k"))
    a = joins.asof_last(t.orders, facts, "o_custkey", "o_orderdate", "d", "v", "k", 365).where("last_value IS NOT NULL")
    return a.groupBy(M.band("last_value", [(50000, "low"), (150000, "mid")], "high").alias("last_band")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@q("Q22", """WITH w AS (SELECT user_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
 SELECT date_key, count(*) AS users, round(avg(n), 6) AS mean_n, round(quantile_cont(total, 0.5), 4) AS median_total, round(quantile_cont(total, 0.9), 4) AS p90_total FROM w GROUP BY 1""")
def _(t):
    w = t.events.groupBy("user_id", M.date_key("ts").alias("date_key")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    aggs = [F.count("*").alias("users"), F.round(F.avg("n"), 6).alias("mean_n")]
    return quantiles.grouped(w, ["date_key"], aggs, {"median_total": ("total", 0.5), "p90_total": ("total", 0.9)}, 4)


_NET = "sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) - sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END)"


@q("Q23", f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, {_NET} AS net FROM events GROUP BY 1, 2), f AS (SELECT user_id, sum(net) AS net3 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM d) WHERE rn <= 3 GROUP BY 1),
 o AS (SELECT user_id, CAST(count_if(event_type = 'signup') AS BIGINT) AS signups FROM events GROUP BY 1)
 SELECT CASE WHEN net3 < -50 THEN 'loss' WHEN net3 < 50 THEN 'even' ELSE 'gain' END AS net_band, count(*) AS n, CAST(sum(signups) AS BIGINT) AS signups FROM f LEFT JOIN o USING (user_id) GROUP BY 1""")
def _(t):
    value = lambda k: F.sum(F.when(C("event_type") == k, C("value")).otherwise(0))
    d = t.events.groupBy("user_id", C("ts").cast("date").alias("day")).agg((value("purchase") - value("error")).alias("net"))
    f = windows.first_n(d, ["user_id"], ["day"], 3).groupBy("user_id").agg(F.sum("net").alias("net3"))
    o = t.events.groupBy("user_id").agg(F.count_if(C("event_type") == "signup").alias("signups"))
    return f.join(o, "user_id", "left").groupBy(M.band("net3", [(-50, "loss"), (50, "even")], "gain").alias("net_band")).agg(F.count("*").alias("n"), F.sum("signups").alias("signups"))


@q("Q24", """SELECT CASE WHEN qty < 50 THEN '<50' WHEN qty < 150 THEN '50-149' ELSE '150+' END AS qty_band, count(*) AS n, CAST(sum(returned) AS BIGINT) AS with_return, round(avg(qty), 6) AS mean_qty FROM (SELECT l_orderkey, sum(l_quantity) AS qty, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY 1) GROUP BY 1""")
def _(t):
    o = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), M.flag_any(C("l_returnflag") == "R").alias("returned"))
    return o.groupBy(M.band("qty", [(50, "<50"), (150, "50-149")], "150+").alias("qty_band")).agg(F.count("*").alias("n"), F.sum("returned").alias("with_return"), F.round(F.avg("qty"), 6).alias("mean_qty"))


@q("Q25", """WITH u AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) AS views, sum(CASE WHEN event_type = 'error' THEN value END) AS err, sum(value) AS total FROM events GROUP BY 1)
 SELECT CASE WHEN views < 25 THEN 'low' WHEN views < 50 THEN 'mid' ELSE 'high' END AS view_band, count(*) AS n, round(sum(err) / nullif(sum(total), 0), 8) AS err_share FROM u WHERE views IS NOT NULL GROUP BY 1""")
def _(t):
    of = lambda k: F.when(C("event_type") == k, C("value"))
    u = t.events.groupBy("user_id").agg(F.avg(of("view")).alias("views"), F.sum(of("error")).alias("err"), F.sum("value").alias("total")).where("views IS NOT NULL")
    return u.groupBy(M.band("views", [(25, "low"), (50, "mid")], "high").alias("view_band")).agg(F.count("*").alias("n"), M.share(F.sum("err"), F.sum("total"), 8).alias("err_share"))


@q("Q26", """WITH u AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value END) AS spent, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)
 SELECT user_id, days, round(spent / greatest(days, 1), 6) AS per_day FROM u""")
def _(t):
    u = t.events.groupBy("user_id").agg(F.sum(F.when(C("event_type") == "purchase", C("value"))).alias("spent"), F.count_distinct(C("ts").cast("date")).alias("days"))
    return u.select("user_id", "days", F.round(C("spent") / F.greatest("days", F.lit(1)), 6).alias("per_day"))


_USE = {"USE": ["idiot", "moron", "scum", "the", "und"]}


@q("Q27", f"""SELECT lang, status, count(*) AS n, CAST(count_if(toxic = 1) AS BIGINT) AS toxic, round(100.0 * CAST(count_if(toxic = 1) AS DOUBLE) / count(*), 2) AS pct FROM
 (SELECT doc_id, lang, CASE WHEN bool_or(own AND NOT negated AND NOT historical) THEN 'CURRENT' WHEN bool_or(own AND NOT negated AND historical) THEN 'FORMER' WHEN bool_or(own AND negated) THEN 'DENIES' ELSE 'NOT_MENTIONED' END AS status
  FROM documents LEFT JOIN (SELECT doc_id, NOT family AND NOT hypothetical AS own, negated, historical FROM ({tag_sql(_USE)})) USING (doc_id) GROUP BY 1, 2) JOIN labels USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(t):
    # what a text says of the subject's use: its entities, then the strongest statement among them
    docs = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", "text")
    status = text.status_levels(text.tag_entities(docs, "doc_id", "text", _USE), "doc_id", docs)
    rows = docs.select("doc_id", "lang").join(status, "doc_id").join(t.labels, "doc_id")
    return rows.groupBy("lang", "status").agg(F.count("*").alias("n"), F.count_if(C("toxic") == 1).alias("toxic"), M.percent(C("toxic") == 1).alias("pct")).where("n >= 5")


@q("Q28", """WITH x AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), u AS (SELECT user_id, count(*) AS n, count(DISTINCT k) AS kinds FROM x GROUP BY 1)
 SELECT kinds, count(*) AS users, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1""")
def _(t):
    x = t.events.select("user_id", F.explode(F.map_values(F.from_json("props", "map<string,int>"))).alias("k"))
    u = x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("k").alias("kinds"))
    return u.groupBy("kinds").agg(F.count("*").alias("users"), F.sum("n").alias("n"))


@q("Q29", """WITH f AS (SELECT doc_id, CASE WHEN regexp_matches(text, '%%%|&&&|!! |[|] ') THEN 1 ELSE 0 END AS found, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
 SELECT lang, count(*) AS n, CAST(count_if(found = 1 AND quality = 0) AS BIGINT) AS both_say, CAST(count_if(found = 1 AND quality = 1) AS BIGINT) AS text_only, CAST(count_if(found = 0 AND quality = 0) AS BIGINT) AS coded_only FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    docs = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", C("text").rlike("%%%|&&&|!! |[|] ").cast("int").alias("found"))
    rows = docs.join(t.labels, "doc_id", "left")
    say = lambda f, x: F.count_if((C("found") == f) & (C("quality") == x))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), say(1, 0).alias("both_say"), say(1, 1).alias("text_only"), say(0, 0).alias("coded_only")).where("n >= 3")


@q("Q30", """SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, substr(a.t, 1, 80) AS asked, substr(b.t, 1, 80) AS answered FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) a
 FULL JOIN (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1) b ON a.conv_id = b.conv_id ORDER BY 1 LIMIT 50""")
def _(t):
    say = lambda r, n: t.conversations.where(C("role") == r).groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 80).alias(n))
    return say("user", "asked").join(say("assistant", "answered"), "conv_id", "full_outer").orderBy("conv_id").limit(50)


@q("bench_lab", """SELECT p_brand, o_orderpriority, count(*) AS n, round(100.0 * CAST(count_if(l_returnflag = 'R') AS DOUBLE) / count(*), 4) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_returnflag").join(t.part.select("p_partkey", "p_brand"), C("l_partkey") == C("p_partkey")).join(t.orders.select("o_orderkey", "o_orderpriority"), C("l_orderkey") == C("o_orderkey"))
    return rows.groupBy("p_brand", "o_orderpriority").agg(F.count("*").alias("n"), M.percent(C("l_returnflag") == "R", 4).alias("rate"))


def _day_features(t):
    """A user's readings of a day as a JSON array, as a text tool leaves its findings: kind, k, and negated (of small value).
    Kinds other than errors are findings; a day of errors only has an empty array, and one without props a null."""
    e = t.events.select("user_id", C("ts").cast("date").alias("day"), "event_id", C("event_type").alias("kind"), F.from_json("props", "k int")["k"].alias("k"), (C("value") < 20).alias("negated"))
    found = F.sort_array(F.collect_list(F.when(C("kind") != "error", F.struct("event_id", F.struct("kind", "k", "negated").alias("item")))))
    return e.groupBy("user_id", "day").agg(F.when(F.count("k") > 0, F.to_json(F.transform(found, lambda x: x["item"]))).alias("items"))


_FEATURES = """SELECT user_id, day, CASE WHEN count(k) > 0 THEN coalesce(to_json(list({'kind': kind, 'k': k, 'negated': negated} ORDER BY event_id) FILTER (WHERE kind <> 'error')), '[]') END AS items
 FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value < 20 AS negated FROM events) GROUP BY 1, 2"""
_ITEMS = "unnest(CAST(items AS STRUCT(kind VARCHAR, k INTEGER, negated BOOLEAN)[])) AS x"


@q("bench_json", f"""SELECT c_mktsegment, x.kind AS kind, x.k % 10 AS k, count(*) AS n FROM (SELECT user_id, {_ITEMS} FROM ({_FEATURES})) JOIN customer ON user_id = c_custkey WHERE NOT x.negated GROUP BY ALL""")
def _(t):
    items = arrays.elements(_day_features(t), "items", {"kind": "string", "k": "int", "negated": "boolean"}, ["user_id"]).where("NOT negated")
    items = items.groupBy("user_id", "kind", (C("k") % 10).alias("k")).agg(F.count("*").alias("n"))  # before the join
    return items.join(t.customer.select("c_custkey", "c_mktsegment"), C("user_id") == C("c_custkey")).groupBy("c_mktsegment", "kind", "k").agg(F.sum("n").alias("n"))


@q("json_features_outer", f"""SELECT items IS NULL AS no_text, n_items = 0 AS no_item, count(*) AS days, CAST(sum(coalesce(n_items, 0)) AS BIGINT) AS n_items, CAST(sum(coalesce(n_negated, 0)) AS BIGINT) AS n_negated
 FROM (SELECT user_id, day, items, coalesce(len(list), 0) AS n_items, len(list_filter(list, lambda x: x.negated)) AS n_negated FROM (SELECT *, CAST(items AS STRUCT(kind VARCHAR, k INTEGER, negated BOOLEAN)[]) AS list FROM ({_FEATURES}))) GROUP BY ALL""")
def _(t):
    # days without an item stay, as VARIANT this time
    days = _day_features(t).select("user_id", "day", C("items").isNull().alias("no_text"), F.parse_json("items").alias("items"))
    items = arrays.elements(days, "items", {"kind": "string", "negated": "boolean"}, ["user_id", "day", "no_text"], outer=True)
    by_day = items.groupBy("user_id", "day", "no_text").agg(F.count("kind").alias("n_items"), F.count_if("negated").alias("n_negated"))
    return by_day.groupBy("no_text", (C("n_items") == 0).alias("no_item")).agg(F.count("*").alias("days"), F.sum("n_items").alias("n_items"), F.sum("n_negated").alias("n_negated"))


@q("Q19_paths", "SELECT prev, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY 1, 2")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("prev", F.lag("event_type").over(w)).where("prev IS NOT NULL").groupBy("prev", "event_type").agg(F.count("*").alias("n"))
