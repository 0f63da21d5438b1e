"""Exact order statistics for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, which is
right for groups with a known bound (a pixel's calendar, a 3 x 3 box) and fatal for a
zone that holds a third of the table.  ``select_ranks`` finds exact ranks without ever
bringing a whole group to one task:

1. a histogram over monotone logarithmic bins, one map-side combined count;
2. cumulated per group (thousands of bins at most) it names the bins that hold a wanted rank;
3. only the rows of those bins are read again, collapsed to value counts and ordered, each
   bin on its own.  Bins decide the balance of the work, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_nulls

BINS_PER_E = 1024


def _bin(value: Column, resolution: int) -> Column:
    """Monotone bin number: linear near zero, logarithmic beyond a millionth."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1e6) * resolution)


def select_ranks(df: DataFrame, keys: Sequence[str], value: str,
                 ranks: Mapping[str, Column], resolution: int = BINS_PER_E) -> DataFrame:
    """Exact values at given 0-based ranks of each group.

    ``ranks`` maps an output column to an expression over ``n`` (the group's non-null
    count).  Returns ``keys``, ``n`` and one column per rank.  NULL is a group like any other.
    """
    keys = list(keys)
    names = list(ranks)
    base = (df.where(F.col(value).isNotNull())
            .select(*keys, F.col(value).cast("double").alias("_v"))
            .withColumn("_b", _bin(F.col("_v"), resolution)))
    bins = base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    bins = (bins.withColumn("_end", F.sum("_m").over(upto)).withColumn("n", F.sum("_m").over(whole))
            .withColumn("_start", F.col("_end") - F.col("_m"))
            .withColumn("_t", F.array(*[ranks[k].cast("long") for k in names])))
    wanted = (bins.where(F.exists("_t", lambda r: (r >= F.col("_start")) & (r < F.col("_end"))))
              .select(*keys, "_b", "_start", "n", "_t"))

    counted = (join_nulls(base, wanted, [*keys, "_b"])
               .groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_start").alias("_start"),
                                               F.first("n").alias("n"), F.first("_t").alias("_t")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    hits = (counted.withColumn("_hi", F.col("_start") + F.sum("_c").over(inside))
            .withColumn("_lo", F.col("_hi") - F.col("_c")))
    picks = [F.max(F.when((F.col("_t")[i] >= F.col("_lo")) & (F.col("_t")[i] < F.col("_hi")), F.col("_v"))).alias(k)
             for i, k in enumerate(names)]
    return hits.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], resolution: int = BINS_PER_E) -> DataFrame:
    """Exact linearly interpolated quantiles per group, for groups of any size.

    Returns ``keys``, ``n`` (non-null count) and one column per entry of ``probs``.
    """
    ranks: dict[str, Column] = {}
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"_lo_{name}"] = F.floor(pos)
        ranks[f"_hi_{name}"] = F.ceil(pos)
    got = select_ranks(df, keys, value, ranks, resolution)
    out = [F.col(k) for k in keys] + [F.col("n")]
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*out)


def sorted_median(sorted_array: Column) -> Column:
    """Median of an already sorted array without nulls; NULL when empty."""
    n = F.size(sorted_array)
    lo = F.get(sorted_array, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(sorted_array, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)
