"""URL filter: n-grams by hand, rules by SQL, names never seen, and very long urls."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from starweave.llm import urls

JUNK = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
NAME = r"://(?:www\.|m\.|blog\.)?([^.]*)\."


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "x\U0001f600é漢\n/abc\U0001f601", "\U0001f600" * 7, "aaaa\r\n b"])
def test_runs_are_by_hand(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    for n in (1, 2, 3, 5):
        assert df.select(urls._runs(F.col("t"), n)).first()[0] == [text[i : i + n] for i in range(len(text) - n + 1)]


def test_grams_and_probability_are_brute_force(spark):
    rows = [("example.com", "/a/b"), ("", ""), ("é.org", "/\U0001f600x"), ("aaaaaaa", "/")]
    df = spark.createDataFrame(rows, "h string, p string")
    weights, bias = [((7 * i) % 13 - 6) / 10 for i in range(urls.BUCKETS)], -0.25
    texts = sorted({(tag, f"^{t}$"[i : i + n]) for h, p in rows for tag, t in (("h", h), ("p", p)) for n in urls.GRAMS for i in range(len(t) + 3 - n)})
    bucket = {(r.tag, r.g): r.b for r in spark.createDataFrame(texts, "tag string, g string").select("*", F.pmod(F.xxhash64("tag", "g"), F.lit(urls.BUCKETS)).alias("b")).collect()}
    for r in df.select("*", urls.grams(F.col("h"), F.col("p")).alias("g"), urls.block_probability(F.col("h"), F.col("p"), weights, bias).alias("q")).collect():
        want = {bucket[tag, f"^{t}$"[i : i + n]] for tag, t in (("h", r.h), ("p", r.p)) for n in urls.GRAMS for i in range(len(t) + 3 - n)}
        assert set(r.g) == want and len(r.g) == len(want)
        assert r.q == pytest.approx(1 / (1 + 2.718281828459045 ** -(bias + sum(weights[b] for b in want))))


def test_rules_are_their_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    want = con.execute(rf"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(verdict, h, p) AS (VALUES {rules})
    SELECT page_id, host, path, arg_max(h || p, length(h || p)) FILTER (WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
     arg_max(verdict, length(h || p)) FILTER (WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS verdict FROM u, r GROUP BY ALL""").fetchall()
    got = {r.page_id: r for r in urls.judge(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert len(got) == len(want)
    for page_id, host, path, rule, verdict in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.block_probability >= urls.MIN_BLOCK else "allow"))


def test_names_never_seen(spark):
    """The site names of the given pages are left out of the fit; the others decide. And five folds over all names."""
    labelled = urls.default_labelled(spark)
    name = F.regexp_extract("url", NAME, 1)
    weights, bias = urls.fit(labelled.where(~name.isin(JUNK)))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url IS NOT NULL")
    said = urls.block_probability(urls.host(F.col("url")), urls.path(F.col("url")), weights, bias) >= urls.MIN_BLOCK
    n = {(r.junk, r.said): r["count"] for r in pages.select(F.col("url").rlike("|".join(JUNK)).alias("junk"), said.alias("said")).groupBy("junk", "said").count().collect()}
    assert n.get((False, True), 0) == 0 and n[True, True] / (n[True, True] + n.get((True, False), 0)) > 0.6
    folds = urls.held_out(labelled, F.pmod(F.crc32(name.cast("binary")), F.lit(5)), 5).collect()
    said = [r for r in folds if r.probability >= urls.MIN_BLOCK]
    assert len(folds) == labelled.count() and sum(r.label for r in said) / len(said) > 0.75


def test_long_urls_and_empty_tables(spark):
    weights, bias = [0.01] * urls.BUCKETS, 0.0
    took = {}
    for n in (100_000, 100_000, 1_000_000):  # the first also compiles
        df = spark.createDataFrame([("http://a.example.com/" + "ab\U0001f600é-x/" * (n // 8),)], "url string").cache()
        df.count()
        began = time.time()
        assert df.select(urls.block_probability(urls.host(F.col("url")), urls.path(F.col("url")), weights, bias).alias("q")).first().q > 0.5
        took[n] = time.time() - began
    assert took[1_000_000] < 30
    pages = spark.createDataFrame([], "page_id long, url string, host int, rule int, g string")
    assert urls.judge(pages).collect() == []
