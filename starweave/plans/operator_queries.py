"""One query an operator, bound to the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import checks, joins, refresh, text, windows
from starweave.plans.registry import Registry
from starweave.sources import io

R = Registry()
q = R.query

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "pages", "labels", "conversations")
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES)


@q("scan_count", _COUNTS)
def _(t):
    # through the session's catalogue: each table has a name there, and is read by it
    spark, mark = t.region.sparkSession, uuid.uuid4().hex
    frames = {}
    for n in NAMES:
        getattr(t, n).createOrReplaceTempView(f"scan_{n}_{mark}")
        frames[n] = spark.table(f"scan_{n}_{mark}")
    counts = checks.table_counts(frames)
    for n in NAMES:
        spark.catalog.dropTempView(f"scan_{n}_{mark}")
    return counts


@q("table_counts", _COUNTS)
def _(t):
    return checks.table_counts({n: getattr(t, n) for n in NAMES})


@q("header_row_drop", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    # files with a header line each, read as if they had none
    rows, path = t.customer.select("c_custkey", "c_name", "c_mktsegment"), io.work_path(t.customer.sparkSession, "headed")
    rows.write.option("header", True).csv(path)
    return io.drop_header_rows(rows.sparkSession.read.schema(rows.schema).csv(path))


@q("capped_scan", "SELECT least(1000, count(*)) AS n_rows FROM lineitem")
def _(t):
    return io.cap(t.lineitem, 1000).agg(F.count("*").alias("n_rows"))


@q("date_spine", """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name,
 CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
 CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS week_end,
 CAST(month(d) AS INTEGER) AS "month", monthname(d) AS month_name, CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end,
 CAST(quarter(d) AS INTEGER) AS "quarter", CAST(date_trunc('quarter', d) AS DATE) AS quarter_start, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
 CAST(year(d) AS INTEGER) AS "year", CAST(date_trunc('year', d) AS DATE) AS year_start, CAST(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS year_end,
 CAST(year(d) * 100 + month(d) AS INTEGER) AS year_month, dayofweek(d) IN (0, 6) AS is_weekend, day(d) = 1 AS is_month_start, CAST(d AS DATE) = last_day(d) AS is_month_end,
 dayofyear(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY) = 366 AS is_leap_year, strftime(d, '%Y-%m') AS year_month_name
FROM (SELECT unnest(generate_series((SELECT date_trunc('year', min(o_orderdate)) FROM orders), (SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM orders), INTERVAL 1 DAY)) AS d)
""")
def _(t):
    lo, hi = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyy-01-01"), F.date_format(F.max("o_orderdate"), "yyyy-12-31")).first()
    return io.date_spine(t._spark, lo, hi)


@q("apply_mapping", "SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS subject_code, TRY_CAST(o_orderpriority AS INTEGER) AS priority_no, CAST(o_totalprice AS BIGINT) AS whole_price, o_orderdate AS ordered_at FROM orders WHERE false UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), TRY_CAST(o_orderpriority AS INTEGER), CAST(trunc(o_totalprice) AS BIGINT), o_orderdate FROM orders")
def _(t):
    return M.apply_mapping(t.orders, [("o_orderkey", "order_id", "long"), ("o_custkey", "subject_code", "string"), ("o_orderpriority", "priority_no", "int"), ("o_totalprice", "whole_price", "long"), ("o_orderdate", "ordered_at", "timestamp_ntz")])


@q("date_keys", """SELECT o_orderkey, l_linenumber, l_partkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS order_date_key, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS ship_date_key,
 CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ship_year_month FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = M.add_date_keys(rows, [("order_date_key", "o_orderdate"), ("ship_date_key", "l_shipdate")])
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", "order_date_key", "ship_date_key", M.year_month("ship_date_key").alias("ship_year_month"))


@q("blank_presence", "SELECT CAST(count_if(x IS NOT NULL AND trim(x) <> '') AS BIGINT) AS present, CAST(count_if(x IS NULL OR trim(x) = '') AS BIGINT) AS blank FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS x FROM customer)")
def _(t):
    x = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment"))
    return t.customer.select(x.alias("x")).agg(F.count_if(M.present("x")).alias("present"), F.count_if(~M.present("x")).alias("blank"))


@q("lookup_dim", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def _(t):
    return joins.lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.part.where("p_size > 10"), "l_partkey", "p_partkey", ["p_brand", "p_type"])


@q("time_to_event", "SELECT l_orderkey, l_linenumber, l_partkey, (epoch(date_trunc('second', l_shipdate)) - epoch(date_trunc('second', o_orderdate))) / 3600.0 AS hours_to_ship FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    rows = joins.lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), t.orders, "l_orderkey", "o_orderkey", ["o_orderdate"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", M.duration("o_orderdate", "l_shipdate", "hour").alias("hours_to_ship"))


@q("abnormal_flag", "SELECT event_id, CASE WHEN value IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL THEN value < lo OR value > hi END AS abnormal FROM (SELECT event_id, value, CASE WHEN event_type <> 'error' THEN 10.0 END AS lo, 50.0 AS hi FROM events)")
def _(t):
    lo = F.when(F.col("event_type") != "error", 10.0)
    return t.events.select("event_id", M.abnormal(F.col("value"), lo, F.lit(50.0)).alias("abnormal"))


@q("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@q("semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


_ASOF = """SELECT o_orderkey, o_custkey, {v} AS last_value FROM orders o LEFT JOIN (SELECT a.o_orderkey AS k, arg_max(b.value, (b.ts, b.event_id)) AS v
 FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 10593 DAY - to_days(CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) // 80 * 79) AS at FROM orders) a JOIN events b ON b.user_id = a.o_custkey AND b.ts < a.at{w} GROUP BY a.o_orderkey) ON k = o_orderkey"""


def _shifted(t):
    # order times laid over the month of the readings
    days = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date"))
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(10593) - F.floor(days / 80).cast("int") * 79)
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), at.cast("timestamp_ntz").alias("at"))


@q("asof_last", _ASOF.format(v="v", w=""))
def _(t):
    out = joins.asof_last(_shifted(t), t.events.withColumnRenamed("ts", "event_ts"), "user_id", "at", "event_ts", "value", "event_id")
    return out.select("o_orderkey", F.col("user_id").alias("o_custkey"), "last_value")


@q("asof_last_bounded", _ASOF.format(v="v", w=" AND b.ts >= a.at - INTERVAL 2 DAY"))
def _(t):
    out = joins.asof_last(_shifted(t), t.events.withColumnRenamed("ts", "event_ts"), "user_id", "at", "event_ts", "value", "event_id", 2)
    return out.select("o_orderkey", F.col("user_id").alias("o_custkey"), "last_value")


@q("range_join_last", _ASOF.format(v="v", w=" AND b.ts >= a.at - INTERVAL 1 DAY"))
def _(t):
    out = joins.range_last(_shifted(t), t.events.select("user_id", "ts", "value", "event_id"), "user_id", "at", "ts", "value", "event_id", 1)
    return out.select("o_orderkey", F.col("user_id").alias("o_custkey"), "last_value")


@q("first_after", "SELECT a.event_id, min(b.ts) AS first_purchase FROM (SELECT * FROM events WHERE event_type = 'signup') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts GROUP BY a.event_id")
def _(t):
    anchors = t.events.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("anchor_ts"))
    later = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("event_ts"))
    return joins.first_after(anchors, later, "user_id", "anchor_ts", "event_ts", "first_purchase").select("event_id", "first_purchase")


@q("contains_join", "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND strpos(a.p_type, split_part(b.p_type, ' ', 1)) > 0")
def _(t):
    a = t.part.select(F.col("p_partkey").alias("a_key"), "p_brand", "p_size", F.col("p_type").alias("a_type"))
    b = t.part.select(F.col("p_partkey").alias("b_key"), "p_brand", "p_size", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("b_word"))
    return joins.containment(a, b, "a_type", "b_word", ["p_brand", "p_size"]).where("a_key < b_key").select("a_key", "b_key")


@q("contains_passage", """SELECT doc_id, item_id FROM documents JOIN (SELECT item_id, regexp_extract(text, '^.{0,40}') AS opening FROM benchmark) ON opening <> '' AND contains(text, opening)""")
def _(t):
    # documents that hold the opening of a benchmark text
    openings = t.benchmark.select("item_id", F.regexp_extract("text", "^.{0,40}", 0).alias("opening"))
    return joins.containment(t.documents.select("doc_id", "text"), openings, "text", "opening", n=8).select("doc_id", "item_id")


@q("role_dates", """SELECT o_orderkey, l_linenumber, l_partkey, CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter, dayname(l_shipdate) AS ship_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    lo, hi = t.lineitem.agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd")).first()
    lo2, hi2 = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).first()
    spine = io.date_spine(t._spark, min(lo, lo2), max(hi, hi2))
    rows = M.add_date_keys(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), [("ok", "o_orderdate"), ("sk", "l_shipdate")])
    rows = joins.lookup(rows.select("o_orderkey", "l_linenumber", "l_partkey", "ok", "sk"), spine.withColumnRenamed("quarter", "order_quarter"), "ok", "date_key", ["order_quarter"])
    return joins.lookup(rows, spine.withColumnRenamed("day_name", "ship_day"), "sk", "date_key", ["ship_day"]).select("o_orderkey", "l_linenumber", "l_partkey", "order_quarter", "ship_day")


@q("readmission", """SELECT o_orderkey, prev IS NOT NULL AS is_repeat, CAST(trunc(date_sub('second', prev, o_orderdate) / 86400.0) AS INTEGER) AS gap_days
 FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)""")
def _(t):
    return windows.readmission(
        t.orders.withColumn("o_end", F.col("o_orderdate")), "o_custkey", "o_orderdate", "o_end", "o_orderkey"
    ).select("o_orderkey", "is_repeat", "gap_days")


@q("next_gap", "SELECT o_orderkey, date_sub('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS days_to_next FROM orders")
def _(t):
    rows = windows.following(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "_next")
    return rows.select("o_orderkey", M.whole_days("o_orderdate", "_next").alias("days_to_next"))


@q("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t):
    return windows.latest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@q("repeat_flag", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS is_later FROM orders")
def _(t):
    return windows.repeat_flag(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "is_later").select("o_orderkey", "is_later")


@q("quartile", "SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY c_acctbal NULLS FIRST, c_custkey) AS INTEGER) AS quarter FROM customer")
def _(t):
    return windows.quartile(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "quarter").select("c_custkey", "quarter")


@q("prior_visits", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_before FROM events")
def _(t):
    return windows.prior_visits(t.events, ["user_id"], "event_type", ["ts", "event_id"], "seen_before").select("event_id", "seen_before")


@q("first_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(t):
    return t.documents.select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@q("touched_keys", "SELECT DISTINCT k AS date_key FROM (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) FROM lineitem WHERE l_returnflag = 'R') WHERE k IS NOT NULL")
def _(t):
    a = t.orders.where("o_orderstatus = 'P'").select(M.date_key("o_orderdate").alias("k"))
    b = t.lineitem.where("l_returnflag = 'R'").select(M.date_key("l_shipdate").alias("k"))
    return refresh.touched_keys([(a, "k"), (b, "k")], "date_key")


@q("carry_forward", "SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS n_orders, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) % 64 AS bucket FROM orders GROUP BY ALL")
def _(t):
    def build(rows):
        return rows.groupBy("date_key").agg(F.count("*").alias("n_orders"))

    rows = M.add_date_keys(t.orders, [("date_key", "o_orderdate")])
    of_key = lambda k: F.pmod(k, F.lit(64))
    old = build(rows.where("o_orderkey % 10 <> 3")).withColumn("bucket", of_key(F.col("date_key")))
    touched = rows.where("o_orderkey % 10 = 3").select("date_key").distinct()
    new = build(rows.join(touched, "date_key", "left_semi")).withColumn("bucket", of_key(F.col("date_key")))
    return refresh.overlay(refresh.carry_forward(new, old, touched, "date_key", "bucket", of_key), old, touched, "date_key", "bucket", of_key)


@q("partition_overwrite", "SELECT bucket, count(*) AS n_rows, CAST(sum(CASE WHEN bucket = 3 THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM (SELECT c_custkey % 8 AS bucket FROM customer) GROUP BY bucket")
def _(t):
    # the table is written by bucket, then the files of one bucket are replaced
    rows, path = t.customer.select((F.col("c_custkey") % 8).alias("bucket"), F.lit(1).alias("w")), io.work_path(t._spark, "partitions")
    io.write_table(rows, path, partition="bucket")
    io.overwrite_partitions(rows.where("bucket = 3").withColumn("w", F.lit(2)), path, "bucket", 8)
    out = t._spark.read.schema(rows.schema).parquet(path)
    return out.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.sum("w").alias("weight"))


@q("bucketed", "SELECT CAST(o_orderkey % 16 AS BIGINT) AS bucket, count(*) AS n_orders FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(refresh.bucket("o_orderkey", 16).alias("bucket")).agg(F.count("*").alias("n_orders"))


@q("codec_roundtrip", "SELECT codec, count(*) AS n_rows, CAST(sum(p_size) AS BIGINT) AS sizes, CAST(sum(length(p_name)) AS BIGINT) AS letters FROM part, (VALUES ('zstd'), ('snappy'), ('gzip')) c(codec) GROUP BY codec")
def _(t):
    out = None
    for codec in ("zstd", "snappy", "gzip"):
        path = io.work_path(t._spark, codec)
        io.write_table(t.part, path, codec=codec)
        rows = t._spark.read.schema(t.part.schema).parquet(path)
        rows = rows.agg(F.lit(codec).alias("codec"), F.count("*").alias("n_rows"), F.sum("p_size").alias("sizes"), F.sum(F.length("p_name")).alias("letters"))
        out = rows if out is None else out.union(rows)
    return out


@q("csv_roundtrip", r"SELECT doc_id, md5(replace(replace(text, chr(13), '\r'), chr(10), '\n')) AS text_md5, lang FROM documents")
def _(t):
    path = io.work_path(t._spark, "csv")
    io.write_csv(t.documents.select("doc_id", "text", "lang"), path)
    back = io.read_csv(t._spark, path, "doc_id long, text string, lang string")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@q("csv_escape", r"SELECT doc_id, length(replace(replace(text, chr(13), '\r'), chr(10), '\n')) AS n_escaped FROM documents")
def _(t):
    return io.for_csv(t.documents.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_escaped"))


@q("variant_flatten", "SELECT event_id, props AS props_json FROM events WHERE false UNION ALL SELECT event_id, replace(props, ' ', '') FROM events")
def _(t):
    rows = t.events.select("event_id", F.try_parse_json("props").alias("props_json"))
    return io.flatten_variant(rows, ["props_json"])


@q("variant_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@q("fn_string", """SELECT p_partkey, lower(p_name) AS low, upper(split_part(p_type, ' ', 1)) AS head, trim(concat('  ', p_brand, ' ')) AS trimmed, substr(p_name, 2, 4) AS piece,
 replace(p_type, ' ', '_') AS joined, CAST(strpos(p_type, 'E') AS INTEGER) AS at_e, concat_ws('/', p_brand, p_type) AS both_names, regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred, regexp_matches(p_type, '^[A-M]') AS early, coalesce(nullif(p_brand, ''), 'none') AS label FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", F.lower("p_name").alias("low"), F.upper(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("head"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.substring("p_name", 2, 4).alias("piece"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")).alias("joined"), F.instr("p_type", "E").alias("at_e"), F.concat_ws("/", "p_brand", "p_type").alias("both_names"),
        F.regexp_replace("p_name", "[aeiou]", "*").alias("starred"), F.col("p_type").rlike("^[A-M]").alias("early"), F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("none")).alias("label"),
    )


@q("fn_date", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS qtr, strftime(o_orderdate, '%Y%m') AS ym, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
 CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(weekofyear(o_orderdate) AS INTEGER) AS woy, CAST(o_orderdate - INTERVAL 365 DAY AS DATE) AS year_back, last_day(o_orderdate) AS month_end,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, date_sub('minute', TIMESTAMP '1995-01-01', o_orderdate) AS minutes FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("qtr"), F.date_format(d, "yyyyMM").alias("ym"), F.dayofweek(d).alias("dow"), F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("woy"),
        F.date_sub(d.cast("date"), 365).alias("year_back"), F.last_day(d).alias("month_end"), F.trunc(d.cast("date"), "month").alias("month_start"),
        F.timestamp_diff("MINUTE", F.lit("1995-01-01").cast("timestamp_ntz"), d).alias("minutes"),
    )


@q("fn_math", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, greatest(l_discount, l_tax) AS most, l_quantity / nullif(l_discount, 0) AS per_discount, l_orderkey % 64 AS m, CAST(trunc(l_quantity / 7) AS INTEGER) AS weeks FROM lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.greatest("l_discount", "l_tax").alias("most"),
        (F.col("l_quantity") / F.nullif("l_discount", F.lit(0.0))).alias("per_discount"), F.pmod("l_orderkey", F.lit(64)).alias("m"), (F.col("l_quantity") / 7).cast("int").alias("weeks"),
    )


@q("fn_cond", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS level, TRY_CAST(c_mktsegment AS INTEGER) AS as_int, CASE WHEN regexp_matches(c_mktsegment, '^AUTO') THEN 'car' WHEN regexp_matches(c_mktsegment, 'BUILD') THEN 'house' ELSE 'other' END AS class FROM customer")
def _(t):
    return t.customer.select("c_custkey", M.band("c_acctbal", [(0, "debt"), (1000, "low"), (5000, "mid")], "high").alias("level"), F.col("c_mktsegment").try_cast("int").alias("as_int"), M.first_match("c_mktsegment", [("car", "^AUTO"), ("house", "BUILD")], "other").alias("class"))


@q("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k_text"), F.from_json("props", "k int")["k"].alias("k"))


@q("note_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS full_text, count(*) AS n_notes, max(turn) AS last_order FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def _(t):
    return text.note_concat(t.conversations, ["conv_id"], "turn", "text")


@q("inference_merge", """SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.conv_id IS NOT NULL AS has_left, b.conv_id IS NOT NULL AS has_right, n_user, n_system
 FROM (SELECT conv_id, count(*) AS n_user FROM conversations WHERE role = 'user' GROUP BY 1) a FULL JOIN (SELECT conv_id, count(*) AS n_system FROM conversations WHERE role = 'system' GROUP BY 1) b ON a.conv_id = b.conv_id""")
def _(t):
    a = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n_user"))
    b = t.conversations.where("role = 'system'").groupBy("conv_id").agg(F.count("*").alias("n_system"))
    return joins.presence_merge(a, b, "conv_id", ["n_user"], ["n_system"])


_ROLES = {"user": "user", "assistant": "assistant", "system": "system"}


@q("sections", """SELECT conv_id, role AS section, count(*) AS n_parts FROM conversations WHERE text IS NOT NULL GROUP BY ALL""")
def _(t):
    notes = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", F.concat(F.upper("role"), F.lit(": "), F.regexp_replace("text", r"\s+", " ")).alias("text"))
    report = text.note_concat(notes, ["conv_id"], "turn", "text")
    found = report.select("conv_id", F.explode(text.sections("full_text", _ROLES)).alias("section", "body"))
    return found.select("conv_id", "section", F.size(F.split("body", "\n")).cast("long").alias("n_parts"))


@q("text_clean", r"SELECT doc_id, length(substr(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 2500)) AS n_clean, length(substr(text, 1, 100000)) AS n_guarded, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS n_whole FROM documents")
def _(t):
    whole = F.length(text.clean("text", 1 << 30)).cast("long")
    return t.documents.select("doc_id", F.length(text.clean("text")).cast("long").alias("n_clean"), F.length(text.guard("text")).cast("long").alias("n_guarded"), whole.alias("n_whole"))


@q("first_match_class", "SELECT doc_id, CASE WHEN regexp_matches(text, 'Apache License|Licensed under') THEN 'license' WHEN regexp_matches(text, '[|] ') THEN 'table' WHEN regexp_matches(text, '%%%|&&&') THEN 'symbols' ELSE 'prose' END AS class FROM documents")
def _(t):
    return t.documents.select("doc_id", M.first_match("text", [("license", "Apache License|Licensed under"), ("table", "[|] "), ("symbols", "%%%|&&&")], "prose").alias("class"))


_LEX = {"with": ["with", "with the"], "place": ["on the", "at", "in"]}
# RE2 has no look-around: every sign that ends a word is doubled, so that each of two neighbouring words keeps one
_DOUBLED = r"(' ' || regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ')"


def _whole(words: str) -> str:
    return r"'(?i)[^\p{L}\p{N}_](" + words.replace(" ", "  ") + r")[^\p{L}\p{N}_]'"


_HIT = "SELECT doc_id, '{0}' AS label, CAST(len(h) AS INTEGER) AS n_hits, CAST(len(list_distinct(h)) AS INTEGER) AS n_terms FROM (SELECT doc_id, list_transform(regexp_extract_all({2}, {1}, 1), lambda x: lower(x)) AS h FROM documents) WHERE len(h) > 0"


@q("lexicon_hits", _HIT.format("with", _whole("with the|with"), _DOUBLED) + " UNION ALL " + _HIT.format("place", _whole("on the|at|in"), _DOUBLED))
def _(t):
    return text.lexicon_hits(t.documents, "doc_id", "text", _LEX)


@q("sentences", r"SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), '[' || chr(1) || '\n]+'), lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def _(t):
    rows = t.conversations.where(M.present("text")).withColumn("k", F.struct("conv_id", "turn"))
    return text.sentences(rows, "k", "text").groupBy("k").agg(F.count("*").alias("n_sentences")).select("k.conv_id", "k.turn", "n_sentences")


def _sql_trigger(*phrases: str) -> str:
    """Whether a trigger begins at a word: phrases of one to three words with one blank between."""
    parts = []
    for phrase in phrases:
        first, *rest = phrase.split(" ")
        more = "".join(f" AND lead(t, {2 * k + 1}) OVER d = ' ' AND lower(lead(t, {2 * k + 2}) OVER d) = '{w}'" for k, w in enumerate(rest))
        parts.append(f"(lower(t) = '{first}'{more})")
    return " OR ".join(parts)


# The text as runs of word signs and runs of others; cuts of sentences and terminators of clauses are counted along the runs.
_LABELS = {"insult": ["idiot", "moron", "scum", "of", "und"], "secret": ["token", "de"]}
def tag_sql(labels: dict[str, list[str]]) -> str:
    """Entities of single words in documents, with what is asserted of them."""
    return f"""WITH runs AS (SELECT doc_id, unnest(r) AS t, generate_subscripts(r, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS r FROM documents)),
 marked AS (SELECT *, regexp_full_match(t, '[\\p{{L}}\\p{{N}}_]+') AS word, len(regexp_extract_all(t, '[.!?][ \\t\\n\\r\\f\\v]+|\\n+')) AS cuts, length(t) - length(replace(t, ';', '')) AS semis, lower(t) IN ('but', 'however', 'although', 'except', 'which') AS stop,
  {_sql_trigger("no", "not", "denies", "denied", "without", "never", "negative for", "no evidence of", "absence of")} AS neg, {_sql_trigger("is ruled out", "was ruled out", "unlikely")} AS neg_after,
  {_sql_trigger("history of", "former", "previous", "prior", "past")} AS hist, {_sql_trigger("if", "should", "in case of", "return for")} AS hypo,
  {_sql_trigger("father", "mother", "brother", "sister", "family", "grandmother", "grandfather")} AS fam, {_sql_trigger("possible", "probable", "may", "might", "compatible with", "suspicious for", "cannot exclude")} AS uncert
  FROM runs WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 placed AS (SELECT *, CAST(coalesce(sum(length(t)) OVER b, 0) AS INTEGER) AS start_char, CAST(coalesce(sum(cuts) OVER b, 0) AS INTEGER) AS sentence_no, coalesce(sum(cuts + semis + CAST(stop AS INTEGER)) OVER b, 0) AS clause
  FROM marked WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 said AS (SELECT *, min(i) FILTER (WHERE neg) OVER c < i OR max(i) FILTER (WHERE neg_after) OVER c > i AS negated, min(i) FILTER (WHERE hist) OVER c < i AS historical, min(i) FILTER (WHERE hypo) OVER c < i AS hypothetical,
  min(i) FILTER (WHERE fam) OVER c < i AS family, min(i) FILTER (WHERE uncert) OVER c < i AS uncertain FROM placed WINDOW c AS (PARTITION BY doc_id, clause))
 SELECT doc_id, sentence_no, start_char, CAST(start_char + length(t) AS INTEGER) AS end_char, t AS term, CASE {" ".join(f"WHEN lower(t) IN ({', '.join(repr(w) for w in words)}) THEN '{label}'" for label, words in labels.items())} END AS label,
  {", ".join(f"coalesce({a}, FALSE) AS {a}" for a in text.ASSERTIONS)} FROM said WHERE lower(t) IN ({", ".join(repr(w) for words in labels.values() for w in words)})"""


@q("tag_entities", tag_sql(_LABELS))
def _(t):
    return text.tag_entities(t.documents, "doc_id", "text", _LABELS).drop("sentence")


_SAYS = lambda words: f"regexp_matches({_DOUBLED}, {_whole(words)})"
_STATUS = f"""SELECT doc_id, CASE WHEN {_SAYS('of the|en la')} THEN 'CURRENT' WHEN {_SAYS('of|mit')} THEN 'FORMER' WHEN {_SAYS('and|und')} THEN 'DENIES' ELSE 'NOT_MENTIONED' END AS status FROM documents"""


@q("status_levels", _STATUS)
def _(t):
    # entities whose label says what is asserted of them
    hits = text.lexicon_hits(t.documents, "doc_id", "text", {"stated": ["of the", "en la"], "historical": ["of", "mit"], "negated": ["and", "und"], "family": ["the", "la"]})
    flags = hits.select("doc_id", *((F.col("label") == a).alias(a) for a in text.ASSERTIONS))
    return text.status_levels(flags, "doc_id", t.documents)


@q("code_lookup", """WITH said AS (SELECT l_orderkey, p_brand AS code FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'), looked AS (SELECT l_orderkey, p_brand AS code FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N')
 SELECT l_orderkey, code, min(source) AS source FROM (SELECT *, 'cited' AS source FROM said UNION ALL SELECT *, 'lookup' FROM looked) GROUP BY 1, 2""")
def _(t):
    cited = t.lineitem.where("l_returnflag = 'R'").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("code"))
    terms = t.lineitem.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_partkey").alias("term"), (F.col("l_returnflag") != "N").alias("negated"))
    return text.code_lookup(cited, terms, t.part.select(F.col("p_partkey").alias("term"), F.col("p_brand").alias("code")), "l_orderkey")


@q("dedup_first", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def _(t):
    return text.dedup_first(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@q("feature_rollup", """SELECT user_id, '["' || string_agg(DISTINCT event_type, '","' ORDER BY event_type) || '"]' AS event_type FROM events GROUP BY user_id""")
def _(t):
    return text.rollup_features(t.events, "user_id", ["event_type"])


@q("reconcile", """SELECT table_name, raw_rows, gold_rows, gold_rows - raw_rows AS delta, round(100.0 * CAST(gold_rows AS DOUBLE) / raw_rows, 4) AS coverage_pct, (100.0 * gold_rows / raw_rows > 99 AND gold_rows <> raw_rows) AS mismatch
 FROM (SELECT 'orders' AS table_name, count(*) AS raw_rows, CAST(count_if(o_orderkey % 1000 <> 7) AS BIGINT) AS gold_rows FROM orders UNION ALL SELECT 'customer', count(*), count(*) FROM customer)""")
def _(t):
    raw = checks.table_counts({"orders": t.orders, "customer": t.customer})
    gold = checks.table_counts({"orders": t.orders.where("o_orderkey % 1000 <> 7"), "customer": t.customer})
    return checks.reconcile(raw, gold)


@q("grain_check", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return checks.grain_check(t.lineitem, ["l_orderkey", "l_linenumber"])


@q("running_share", "SELECT nation, orders_n, round(CAST(orders_n AS DOUBLE) / sum(orders_n) OVER (), 8) AS part FROM (SELECT n_name AS nation, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def _(t):
    rows = joins.lookup(joins.lookup(t.orders, t.customer, "o_custkey", "c_custkey", ["c_nationkey"], "inner"), t.nation, "c_nationkey", "n_nationkey", ["n_name"], "inner")
    n = rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders_n"))
    return n.withColumn("part", F.round(F.col("orders_n").cast("double") / F.sum("orders_n").over(Window.partitionBy()), 8))
