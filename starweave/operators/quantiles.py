"""Percentiles: exact ones of groups of any size by distributed selection, and mergeable sketches for roll-ups.

`exact` finds the two ranks that a continuous percentile lies between. A round puts a bracket around them: a bounded-error
summary of each group's values inside the former bracket (Spark's percentile_approx) gives two of these values, at most 4 in
ACCURACY of them apart, between which the ranks lie. Rounds go on until a bracket's distinct values are few. One aggregation
then counts the values below the bracket and each value in it, so a window over the few picks the ranks. Counts confirm
that they lie in the bracket; should a summary have missed, wider brackets are drawn. Every value counts; tasks hold summaries
and the distinct values of one bracket, never a group.

`sketches` keeps KLL sketches as a column of an aggregate; `merged` unites them to any coarser one. The rank error of a
quantile is bounded by `rank_error(k)` with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starweave.sources.io import delete, staged

#: percentile_approx is off by at most one in ACCURACY ranks.
ACCURACY = 2000
#: Values that one bracket holds at the end, at most.
FEW = 1 << 16
#: Tables that one task may hold.
SMALL = 64 << 20


def _ranked(p: float, n: str = "n") -> tuple[Column, Column]:
    at = F.lit(float(p)) * (F.col(n) - 1)
    return F.floor(at).cast("long"), F.ceil(at).cast("long")


def exact(df: DataFrame, by: list[str], targets: dict[str, tuple[str, float]], few: int = FEW, accuracy: int = ACCURACY, written: bool = False) -> DataFrame:
    """by, and a column a target: name to (value column, fraction), interpolated between neighbours as percentile() does.

    Nulls do not count; a group without values has null, and null is a group of its own. NaN is the largest value. Groups
    need not fit anywhere; df is read few times (written to the shared folder first, with the columns needed; written says that
    it is a table already)."""
    spark = df.sparkSession
    values = sorted({c for c, _ in targets.values()})
    rows = df.select(*by, *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)))
    rows = rows if written else staged(rows, "values")
    column = {name: f"v{values.index(c)}" for name, (c, _) in targets.items()}
    fraction = {name: float(p) for name, (_, p) in targets.items()}
    names = list(targets)

    spread, attempts = 2.0, 0
    while True:
        brackets = _brackets(rows, by, names, column, fraction, few, accuracy, spread)
        picked = _pick(rows, brackets, by, names, column, fraction)
        out = staged(picked, "percentiles")
        missed = out.where(" OR ".join(f"`{n}_missed`" for n in names)).limit(1).collect()
        delete(spark, brackets)
        attempts += 1
        if not missed:
            break
        delete(spark, out)
        spread *= 8  # ends at the whole range, which misses nothing
    if not written:
        delete(spark, rows)
    return out.select(*by, *names)


def read_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by the statistics that joins are planned with."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def grouped(df: DataFrame, by: list[str], aggs: list[Column], targets: dict[str, tuple[str, float]], digits: int, small_bytes: int = SMALL) -> DataFrame:
    """by, aggs and the rounded exact percentiles of each group.

    If all tables that df reads have at most small_bytes together, a group fits in a task, and one aggregation has it all;
    else df is written once and the percentiles are selected (`exact`). The rows are the same."""
    if read_bytes(df) <= small_bytes:
        return df.groupBy(*by).agg(*aggs, *(F.round(F.percentile(F.col(c).cast("double"), F.lit(float(p))), digits).alias(n) for n, (c, p) in targets.items()))
    rows = staged(df, "values")
    ranks = exact(rows, by, targets, written=True).withColumnsRenamed({b: f"_of_{b}" for b in by})
    counts = rows.groupBy(*by).agg(*aggs)
    return counts.join(ranks, _same(by)).select(*counts.columns, *(F.round(n, digits).alias(n) for n in targets))


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return on


def _with(rows: DataFrame, brackets: DataFrame | None, by: list[str]) -> DataFrame:
    """rows beside their group's bracket; a group's bracket is one row, so Spark broadcasts or sorts by size."""
    if brackets is None:
        return rows
    if not by:
        return rows.join(F.broadcast(brackets))  # one row
    return rows.join(brackets.withColumnsRenamed({b: f"_of_{b}" for b in by}), _same(by)).drop(*(f"_of_{b}" for b in by))


def _brackets(rows: DataFrame, by: list[str], names: list[str], column: dict[str, str], fraction: dict[str, float], few: int, accuracy: int, spread: float) -> DataFrame:
    """by, and for each target n, lo, hi (the bracket), below (values under lo)."""
    spark, former, inside = rows.sparkSession, None, None
    while True:
        met = _with(rows, former, by)
        aggs = []
        for t in names:
            v = F.col(column[t])
            if former is None:
                aggs += [F.count(v).alias(f"{t}_n"), F.percentile_approx(v, [float(x) for x in _around(fraction[t], spread / accuracy)], accuracy).alias(f"{t}_q")]
            else:
                # the ranks as a share of what lies in the former bracket differ by group, so all steps are asked for
                within = F.when((v >= F.col(f"{t}_lo")) & (v <= F.col(f"{t}_hi")), v)
                steps = [i / 64 for i in range(65)]
                aggs += [
                    F.first(f"{t}_n").alias(f"{t}_n"), F.first(f"{t}_lo").alias(f"{t}_was_lo"), F.first(f"{t}_hi").alias(f"{t}_was_hi"),
                    F.count_if(v < F.col(f"{t}_lo")).alias(f"{t}_below"), F.count(within).alias(f"{t}_inside"), F.percentile_approx(within, steps, accuracy).alias(f"{t}_q"),
                ]
        got = met.groupBy(*by).agg(*aggs)
        cols = [F.col(b) for b in by]
        for t in names:
            if former is None:
                cols += [F.col(f"{t}_n"), F.col(f"{t}_q")[0].alias(f"{t}_lo"), F.col(f"{t}_q")[1].alias(f"{t}_hi")]
            else:
                lo, hi = _ranked(fraction[t], f"{t}_n")
                share = lambda r: (r - F.col(f"{t}_below")) / F.greatest(F.col(f"{t}_inside") - 1, F.lit(1)) * 64  # noqa: E731, B023
                left = F.greatest(F.floor(share(lo) - spread * 64 / accuracy).cast("int") - 1, F.lit(0))
                right = F.least(F.ceil(share(hi) + spread * 64 / accuracy).cast("int") + 1, F.lit(64))
                cols += [
                    F.col(f"{t}_n"), F.coalesce(F.get(f"{t}_q", left), F.col(f"{t}_was_lo")).alias(f"{t}_lo"), F.coalesce(F.get(f"{t}_q", right), F.col(f"{t}_was_hi")).alias(f"{t}_hi"),
                ]
        new = staged(got.select(*cols), "brackets")
        if former is not None:
            delete(spark, former)
        # what a bracket may hold: the first keeps 4 spreads of the values, each further one 4 of 64 steps
        most = new.agg(F.max(F.greatest(*(F.when(F.col(f"{t}_lo") < F.col(f"{t}_hi"), F.col(f"{t}_n")).otherwise(0) for t in names), F.lit(0)))).first()[0] or 0
        inside = 2 * (spread + 1) / accuracy if inside is None else inside * 6 / 64
        former = new
        if most * min(1.0, inside) <= few or spread * 2 >= accuracy:
            return new


def _around(p: float, by: float) -> tuple[float, float]:
    return max(0.0, p - by), min(1.0, p + by)


def _pick(rows: DataFrame, brackets: DataFrame, by: list[str], names: list[str], column: dict[str, str], fraction: dict[str, float]) -> DataFrame:
    """by, each target's value, and whether its ranks were outside of the bracket."""
    met = _with(rows, brackets, by)
    slot = lambda t: F.struct(
        F.lit(names.index(t)).alias("t"),
        F.when(F.col(column[t]) < F.col(f"{t}_lo"), F.lit(None).cast("double")).otherwise(F.col(column[t])).alias("v"),
        (F.col(column[t]) <= F.col(f"{t}_hi")).alias("in"), F.col(f"{t}_n").alias("n"),
    )
    slots = met.select(*by, F.explode(F.array(*(slot(t) for t in names))).alias("s")).select(*by, "s.*").where("in")
    counts = slots.groupBy(*by, "t", "v", "n").agg(F.count("*").alias("many"))  # all below are one slot
    upto = counts.withColumn("upto", F.sum("many").over(Window.partitionBy(*by, "t").orderBy(F.col("v").asc_nulls_first())))
    cols = []
    for i, t in enumerate(names):
        own = F.col("t") == i
        lo, hi = _ranked(fraction[t])
        at = lambda r: F.min(F.when(own & (F.col("upto") > r) & F.col("v").isNotNull(), F.col("v")))  # noqa: E731, B023
        low, high = at(lo), at(hi)
        share = F.max(F.when(own, F.lit(fraction[t]) * (F.col("n") - 1) - lo))
        # nothing to find without values; else the ranks must not lie below the bracket, nor above it
        below = F.max(F.when(own & F.col("v").isNull(), F.col("upto") > lo))
        cols += [(low + share * (high - low)).alias(t), F.coalesce(below, F.lit(False)).alias(f"{t}_under"), high.isNull().alias(f"{t}_over")]
    found = upto.groupBy(*by).agg(*cols)
    every = brackets.select(*by, *(f"{t}_n" for t in names))
    joined = every.join(found.withColumnsRenamed({b: f"_of_{b}" for b in by}), _same(by), "left") if by else every.join(F.broadcast(found), F.lit(True), "left")
    missed = lambda t: ((F.col(f"{t}_n") > 0) & F.coalesce(F.col(f"{t}_under") | F.col(f"{t}_over"), F.lit(True))).alias(f"{t}_missed")
    return joined.select(*by, *names, *(missed(t) for t in names))


# -- sketches


def rank_error(k: int = 200) -> float:
    """Bound of a KLL sketch's rank error for one quantile, with 99 % confidence, by the published fit of its parameters."""
    return 2.296 / k**0.9723


def sketches(df: DataFrame, by: list[Column | str], column: str, out: str, k: int = 200) -> DataFrame:
    """A KLL sketch of column a group (null where it has no values)."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias(out), F.count(column).alias(f"{out}_n"))


def merged(df: DataFrame, by: list[Column | str], column: str, k: int = 200) -> DataFrame:
    """Sketches of finer groups united, with the count beside."""
    return df.groupBy(*by).agg(F.kll_merge_agg_double(column, k).alias(column), F.sum(f"{column}_n").alias(f"{column}_n"))


def quantile(sketch: Column | str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))
