"""Positions and exact percentiles inside groups, without a group in one task.

``Window.partitionBy(key)`` and Spark's ``percentile`` send every row of a key
to one task; with one trace (the pooled ``untraced`` one) or one time window
holding a third of all rows that task becomes the job.  Here a group is cut
into ranges of its order by a monotone bucket of the order column: totals per
(key, bucket) are pre-aggregated, a window over these few totals gives every
bucket its offset, and only rows of one bucket meet in a task.  All groups
take this way, large or small, in one lazy plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a doubling of the value: a bucket spans 0.017 percent of its values' size.
RANGES_PER_DOUBLING = 4096
#: Seconds of a time bucket.
BUCKET_SECONDS = 60


def value_bucket(value: Column) -> Column:
    """A long that never falls as the double ``value`` grows (NaN last, as Spark sorts); null for null."""
    v = value.cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1100) * RANGES_PER_DOUBLING)     # the least double is 2^-1074
    return (F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v == 0, F.lit(0))
            .when(v < 0, -size).otherwise(size))


def time_bucket(ts: Column) -> Column:
    """The minute of a timestamp; null for null."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(BUCKET_SECONDS * 1_000_000))


def _same(left: str, right: str, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def rank_within_groups(df: DataFrame, keys: list[str], order: list[str], running_sum: str | None = None,
                       bucket: Column | None = None, rank_col: str = "_rank", size_col: str = "_n",
                       cum_col: str = "_cum") -> DataFrame:
    """Add ``rank_col`` (0-based position of the row inside its ``keys`` group
    when sorted by ``order``), ``size_col`` (group size) and optionally
    ``cum_col`` (running sum of ``running_sum`` up to and including the row;
    null values add nothing, null until the first value).

    A segmented prefix scan: positions inside a (group, bucket), plus the
    totals of the buckets before.  ``bucket`` must never fall along
    ``order[0]``; by default it is the minute of that timestamp.  Rows equal on
    (keys, order) get distinct consecutive ranks in arbitrary order; give
    ``order`` a unique tie-break when that matters.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_b", time_bucket(F.col(order[0])) if bucket is None else bucket)
    totals = [F.count(F.lit(1)).alias("_cnt")] + ([F.sum(running_sum).alias("_sum")] if running_sum else [])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    seg = (rows.groupBy(*keys, "_b").agg(*totals)
           .withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
           .withColumn(size_col, F.sum("_cnt").over(group)))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = rows.withColumn("_pos", F.row_number().over(inside) - 1)
    if running_sum:
        seg = seg.withColumn("_sum_before", F.sum("_sum").over(before))
        rows = rows.withColumn("_own", F.sum(running_sum).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.alias("r").join(seg.alias("s"), _same("r", "s", [*keys, "_b"]))
    added = [(F.col("s._off") + F.col("r._pos")).alias(rank_col), F.col(f"s.{size_col}").alias(size_col)]
    if running_sum:
        own, past = F.col("r._own"), F.col("s._sum_before")
        added.append(F.when(past.isNull(), own).when(own.isNull(), past).otherwise(past + own).alias(cum_col))
    return out.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], *added)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      sums: dict[str, Column] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (pandas / numpy 'linear',
    Spark ``percentile``), one row per group: keys + one column per name in
    ``probs``.  Nulls are ignored; groups with no values are absent.

    ``sums`` adds columns of sums over all rows of a group, null values
    included; a group without a value then has null percentiles.

    Rows are first counted by (key, value) map-side, so equal values never
    meet as rows.  Totals per range of values give each range the ranks it
    holds, and only the ranges around the target ranks are sorted.
    """
    keys, sums = list(keys), dict(sums or {})
    base = df.select(*keys, F.col(value).alias("_v"), *[c.alias(f"_s_{name}") for name, c in sums.items()])
    if not sums:
        base = base.where(F.col("_v").isNotNull())
    counts = (base.groupBy(*keys, "_v").agg(F.count("_v").alias("_c"), *[F.sum(f"_s_{s}").alias(f"_s_{s}") for s in sums])
              .withColumn("_b", value_bucket(F.col("_v"))))
    group = Window.partitionBy(*keys)
    before = Window.unboundedPreceding, -1
    seg = (counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), *[F.sum(f"_s_{s}").alias(f"_s_{s}") for s in sums])
           .withColumn("_before", F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(*before)), F.lit(0)))
           .withColumn("_n", F.sum("_c").over(group)))
    for s in sums:
        seg = seg.withColumn(f"_s_{s}", F.sum(f"_s_{s}").over(group))
    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    # every target lies between the ranks floor and ceil of its place
    ranks = [f(x) for x in place.values() for f in (F.floor, F.ceil)]
    holds = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")) for r in ranks]
    seg = seg.where(reduce(lambda a, b: a | b, holds, (F.col("_n") == 0) & F.col("_b").isNull()))
    picked = counts.alias("v").join(seg.alias("s"), _same("v", "s", [*keys, "_b"])).select(
        *[F.col(f"v.{k}").alias(k) for k in keys], F.col("v._b").alias("_b"), F.col("v._v").alias("_v"),
        F.col("v._c").alias("_c"), F.col("s._before").alias("_before"), F.col("s._n").alias("_n"),
        *[F.col(f"s._s_{s}").alias(f"_s_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(*before)
    picked = picked.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_at")) & (rank < F.col("_at") + F.col("_c")), F.col("_v")))

    ends = picked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(f"_s_{s}").alias(f"_s_{s}") for s in sums],
        *[at(f(x)).alias(f"_{end}_{name}") for name, x in place.items() for end, f in (("lo", F.floor), ("hi", F.ceil))])
    return ends.select(*keys, *[F.col(f"_s_{s}").alias(s) for s in sums], *[
        F.when(F.floor(x) == F.ceil(x), F.col(f"_lo_{name}").cast("double"))
        .otherwise((F.ceil(x) - x) * F.col(f"_lo_{name}") + (x - F.floor(x)) * F.col(f"_hi_{name}")).alias(name)
        for name, x in place.items()])
