"""URL filter: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions; the regression is fitted by Spark's own ML library on a small labelled table
(at most MAX_LABELLED rows, the ones with the least hash of their url) and applied as an array of weights.

Edge cases: a null url, or one without `://`, has empty host and path, fits no rule and is judged by what `^$` weighs. Very
long urls are read whole, in time that grows with their length. An empty table gives an empty one; a column of any other name
may stand beside. Ties between rules of one length cannot occur, as one url cannot start two different hosts' rules of equal length.
Repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS, GRAMS, MAX_LABELLED, MIN_BLOCK = 2048, (3, 4, 5), 2000, 0.75

# A small labelled table, made up for this library: 1 is a site to block.
_BLOCKED_HOSTS = (
    "casino-win", "casino-royal", "best-casino", "free-bets", "online-bets", "sport-bets", "poker-win", "jackpot-win", "cheap-pills", "buy-pills",
    "diet-pills", "pharma-cheap", "adult-x", "adult-cams", "xxx-adult", "sexy-cams", "ads-track", "track-click", "click-ads", "pop-ads",
    "spam-farm", "link-farm", "seo-spam", "spam-mail", "free-loan", "fast-loan", "torrent-crack", "warez-crack", "fake-watches", "win-prize",
)
_GOOD_HOSTS = (
    "news", "library", "museum", "weather", "cooking", "gardening", "history", "science", "travel", "university",
    "hospital", "council", "orchestra", "football", "cycling", "physics", "grammar", "recipes", "archive", "atlas",
    "school", "railway", "poetry", "theatre", "chess", "astronomy", "birds", "maps", "health", "free-software", "open-data", "farm-life", "bestiary", "track-and-field", "winter-sports",
)
_PLACES = (("", "example.com", "/en/{}"), ("www.", "example.org", "/fr/{}.html"), ("m.", "example.net", "/de/{}/"), ("blog.", "example.com", "/es/{}"))


def default_labelled(spark: SparkSession) -> DataFrame:
    """(url, label): every host above at every place."""
    rows = [(f"http://{sub}{h}.{dom}{path.format(100 + 7 * i)}", label) for label, hosts in ((1, _BLOCKED_HOSTS), (0, _GOOD_HOSTS)) for i, h in enumerate(hosts) for sub, dom, path in _PLACES]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in rows) + " AS t(url, label)")


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_index(h: Column, p: Column, rules=RULES) -> Column:
    """Place in rules of the longest rule that fits, or null."""
    out = F.lit(None).cast("int")
    for i, (_, rule_host, rule_path) in sorted(enumerate(rules), key=lambda r: len(r[1][1] + r[1][2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _runs(text: Column, n: int) -> Column:
    """All runs of n neighbouring characters, by a look-ahead from each: time grows with the length. A search that starts
    inside a surrogate pair finds its second half, which no run begins with."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}].{%d}))" % (n - 1)), F.lit(1))


def grams(h: Column, p: Column) -> Column:
    """Distinct hash buckets of the character n-grams of ^host$ and ^path$."""

    def of(tag: str, text: Column, n: int) -> Column:
        return F.transform(_runs(text, n), lambda g: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(BUCKETS)).cast("int"))

    framed = (("h", F.concat(F.lit("^"), h, F.lit("$"))), ("p", F.concat(F.lit("^"), p, F.lit("$"))))
    return F.array_distinct(F.flatten(F.array(*(of(tag, text, n) for tag, text in framed for n in GRAMS))))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """(weights, bias) of the regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED).select("url", "label", F.explode(grams(host(F.col("url")), path(F.col("url")))).alias("b"))
    rows = rows.groupBy("url", "label").agg(F.collect_set("b").alias("g"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.when(F.array_contains("g", i), 1.0).otherwise(0.0))
    train = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(dense).alias("features"), "url").coalesce(1).sortWithinPartitions("url", "label")
    model = LogisticRegression(regParam=0.01, maxIter=50, standardization=False).fit(train)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def block_probability(h: Column, p: Column, weights: list[float], bias: float) -> Column:
    table = F.array(*(F.lit(w) for w in weights))
    total = F.aggregate(grams(h, p), F.lit(bias), lambda acc, g: acc + F.element_at(table, g + 1))
    return 1 / (1 + F.exp(-total))


def held_out(labelled: DataFrame, fold_of: Column, folds: int) -> DataFrame:
    """(url, label, fold, probability): every url judged by a regression that saw no url of its fold.

    fold_of gives a url's fold (0 to folds - 1); put urls of one site name in one fold to learn how names never seen fare."""
    parts = []
    rows = labelled.select("url", "label", fold_of.cast("int").alias("fold"))
    for k in range(folds):
        weights, bias = fit(rows.where(F.col("fold") != k).select("url", "label"))
        own = rows.where(F.col("fold") == k)
        parts.append(own.withColumn("probability", block_probability(host(F.col("url")), path(F.col("url")), weights, bias)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, labelled: DataFrame | None = None, id_col="page_id", url_col="url", rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the regression's probability to block."""
    weights, bias = fit(default_labelled(pages.sparkSession) if labelled is None else labelled)
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_rule", rule_index(F.col("host"), F.col("path"), rules))
    p = block_probability(F.col("host"), F.col("path"), weights, bias)
    name, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (verdict, rule_host, rule_path) in enumerate(rules):
        name = F.when(F.col("_rule") == i, rule_host + rule_path).otherwise(name)
        said = F.when(F.col("_rule") == i, verdict).otherwise(said)
    return rows.withColumn("block_probability", p).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(said, F.when(F.col("block_probability") >= MIN_BLOCK, "block").otherwise("allow")).alias("verdict"), "block_probability"
    )
