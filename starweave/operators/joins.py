"""Joins of facts, dimensions and event streams. Catalyst and AQE pick the physical join from sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, columns: list[str], how: str = "left") -> DataFrame:
    """df with columns of dim; dim_key is expected to be unique."""
    small = dim.select(F.col(dim_key).alias("_key"), *columns)
    return df.join(small, F.col(fact_key) == F.col("_key"), how).drop("_key")


def asof_last(events: DataFrame, facts: DataFrame, key: str, ts: str, fact_ts: str, value: str, tie: str, max_age_days: int | None = None) -> DataFrame:
    """events with the latest value of facts before each (strictly), no older than max_age_days.

    Both sides go once through one sorted window by key: no pair of rows is made, so a key with many rows costs a sort.
    Rows without a key have no facts, and stay out of the window.
    """
    left = events.where(F.col(key).isNotNull()).select("*", F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("struct<at:timestamp_ntz,v:double>").alias("_fact"), F.lit(None).cast("long").alias("_tie"))
    right = facts.where(F.col(key).isNotNull()).select(F.col(key), F.col(fact_ts).alias("_at"), F.lit(1).alias("_side"), F.struct(F.col(fact_ts).cast("timestamp_ntz").alias("at"), F.col(value).cast("double").alias("v")).alias("_fact"), F.col(tie).cast("long").alias("_tie"))
    both = left.unionByName(right, allowMissingColumns=True)
    # at one time events come before facts, so a fact at the event's own time is not "before" it
    w = Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).where("_side = 0")
    found = F.col("_last.v")
    if max_age_days is not None:
        found = F.when(F.col("_last.at") >= F.col(ts).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_age_days)), found)
    out = out.withColumn("last_value", found).drop("_at", "_side", "_fact", "_tie", "_last")
    return out.unionByName(events.where(F.col(key).isNull()).withColumn("last_value", F.lit(None).cast("double")), allowMissingColumns=True)


def range_last(events: DataFrame, facts: DataFrame, key: str, ts: str, fact_ts: str, value: str, tie: str, days: int) -> DataFrame:
    """The same by an interval join: equal key, fact within days before the event, then the latest.

    Time is cut into bins of `days`: an event meets the facts of its own bin and of the one before, so a key with many rows is
    dealt out by time, and facts of a bin shrink to what the interval can reach. Rows of events that are equal are one.
    """
    width = days * 86400
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    e = events.withColumn("_bin", F.explode_outer(F.array(bin_of(ts) - 1, bin_of(ts))))
    f = facts.select(F.col(key).alias("_k"), bin_of(fact_ts).alias("_b"), F.col(fact_ts).alias("_t"), F.col(value).alias("_v"), F.col(tie).alias("_tie"))
    on = (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & (F.col("_t") < F.col(ts)) & (F.col("_t") >= F.col(ts) - F.make_dt_interval(F.lit(days)))
    return e.join(f, on, "left").groupBy(*events.columns).agg(F.max_by("_v", F.when(F.col("_k").isNotNull(), F.struct("_t", "_tie"))).alias("last_value"))


def first_after(anchors: DataFrame, events: DataFrame, key: str, anchor_ts: str, event_ts: str, out: str = "first_ts", condition: Column | None = None) -> DataFrame:
    """anchors with the earliest event at or after each anchor. condition may name columns of both sides and then makes pairs;
    without it, both sides go once through one window by key."""
    if condition is None:
        keyed = F.col(key).isNotNull() & F.col(anchor_ts).isNotNull()  # the others have no event, and stay out of the window
        side = anchors.where(keyed).select("*", F.col(anchor_ts).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(events.schema[event_ts].dataType).alias("_event"))
        later = events.where(F.col(key).isNotNull() & F.col(event_ts).isNotNull()).select(F.col(key), F.col(event_ts).alias("_at"), F.lit(1).alias("_side"), F.col(event_ts).alias("_event"))
        both = side.unionByName(later, allowMissingColumns=True)
        w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        found = both.withColumn(out, F.first("_event", ignorenulls=True).over(w)).where("_side = 0").drop("_at", "_side", "_event")
        return found.unionByName(anchors.where(~keyed).withColumn(out, F.lit(None).cast(events.schema[event_ts].dataType)), allowMissingColumns=True)
    e = events.withColumnRenamed(key, "_k")
    on = (F.col(key) == F.col("_k")) & (F.col(event_ts) >= F.col(anchor_ts))
    if condition is not None:
        on = on & condition
    return anchors.join(e, on, "left").groupBy(*anchors.columns).agg(F.min(event_ts).alias(out))


#: Texts are cut into pieces of about so many characters before their blocks are taken: no array of blocks grows with a text.
PIECE_CHARS = 4096
#: Phrases of so many characters in all are broadcast; beyond that, blocks are joined by shuffles.
BROADCAST_CHARS = 500_000


def _blocks(text: Column, n: int) -> Column:
    """Distinct runs of n characters that begin at every n-th character; what is left at the end is none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s).{%d}" % n), F.lit(0)))


def containment(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, on: list[str] | None = None, n: int = 3) -> DataFrame:
    """Pairs of a text and a phrase that is part of it (case counts), beside equal values of the columns in on.

    An inverted index makes the candidates. Texts are cut into blocks of k characters. Wherever a phrase of 2k - 1 characters or
    more begins in a text, it covers a whole block; k is n, or less for phrases too short for that. So a phrase is entered k
    times: for each place of its first whole block under the block from there on that the fewest texts hold, or not at all where
    no text holds one of them. Only hashes go with the blocks: candidates meet the whole texts and phrases once, and are compared
    in full. Empty and null phrases are in no text. Columns of both sides stay, equal rows as many; names must differ but for
    those in on. The sides are read more than once.
    """
    on = on or []
    words = phrases.where(F.length(phrase) > 0)
    width = F.least(F.lit(n), F.floor((F.length(phrase) + 1) / 2).cast("int"))
    chars = {r[0]: r[1] for r in words.groupBy(width).agg(F.sum(F.length(phrase))).collect()}  # at most n rows
    if not chars:
        return texts.join(words.drop(*on), F.lit(False))
    # blocks of texts look as small as the texts' files to the planner, but must never be what is broadcast
    side = F.broadcast if sum(chars.values()) <= BROADCAST_CHARS else lambda df: df.hint("merge")
    text_key, phrase_key = F.sha2(text, 256).alias("_text"), F.sha2(phrase, 256).alias("_phrase")
    whole = math.lcm(*chars)  # no block lies in two pieces
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % (whole * max(1, PIECE_CHARS // whole))), F.lit(0))
    blocks = F.flatten(F.array(*(_blocks(F.col("_piece"), k) for k in sorted(chars))))
    parts = texts.select(*on, text_key, F.explode(pieces).alias("_piece")).select(*on, "_text", F.explode(blocks).alias("_gram"))

    by_place = F.coalesce(*(F.when(width == k, F.array(*(_blocks(F.substr(F.col(phrase), F.lit(at + 1)), k) for at in range(k)))) for k in sorted(chars)))
    own = words.select(*on, phrase).distinct().select(*on, phrase_key, F.posexplode(by_place).alias("_at", "_own")).select(*on, "_phrase", "_at", F.explode("_own").alias("_gram"))
    # how many pieces of texts hold each block that any phrase has
    held = parts.join(side(own.select(*on, "_gram").distinct()), [*on, "_gram"], "left_semi").groupBy(*on, "_gram").agg(F.count("*").alias("_held"))
    entry = own.join(held, [*on, "_gram"], "left").groupBy(*on, "_phrase", "_at").agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("held"), F.col("_gram").alias("gram"))).alias("_least"))
    entry = entry.where("_least.held > 0").select(*on, "_phrase", F.col("_least.gram").alias("_gram"))
    found = parts.join(side(entry), [*on, "_gram"]).select(*on, "_text", "_phrase").distinct()
    pairs = texts.withColumn("_text", text_key).join(found, [*on, "_text"]).join(words.withColumn("_phrase", phrase_key), [*on, "_phrase"])
    return pairs.where(F.contains(F.col(text), F.col(phrase))).drop("_text", "_phrase")


def full_merge(frames: dict[str, DataFrame], keys: list[str], zero: list[str]) -> DataFrame:
    """Full outer join on keys of pre-aggregated frames; missing measures are 0."""
    out: DataFrame | None = None
    for frame in frames.values():
        out = frame if out is None else out.join(frame, keys, "full_outer")
    return out.fillna(0, subset=zero)


def star_rollup(base: DataFrame, children: dict[str, tuple[DataFrame, str, list[Column]]], key: str, zero: dict[str, float | int]) -> DataFrame:
    """base with one pre-aggregated row of each child per key; measures in zero default to it, others stay null.

    Each child shrinks to one row per key before its join, so nothing fans out and every shuffle is on the same key.
    """
    out = base
    for child, child_key, aggs in children.values():
        out = out.join(child.groupBy(F.col(child_key).alias(key)).agg(*aggs), key, "left")
    return out.fillna(zero)


def presence_merge(left: DataFrame, right: DataFrame, key: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Full outer join of two feature tables: which side a key has, and the columns of both."""
    a = left.select(F.col(key).alias("_l"), *left_cols)
    b = right.select(F.col(key).alias("_r"), *right_cols)
    return a.join(b, F.col("_l") == F.col("_r"), "full_outer").select(
        F.coalesce("_l", "_r").alias(key), F.col("_l").isNotNull().alias("has_left"), F.col("_r").isNotNull().alias("has_right"), *left_cols, *right_cols
    )
