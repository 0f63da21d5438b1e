"""Ordered access to long series without one task per series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_nulls


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 chunk: Column, columns: Mapping[str, str]) -> DataFrame:
    """``lag`` for series of any length.

    ``chunk`` must grow with ``order`` (a day number, a sequence number divided by a block
    size).  Rows see their predecessor inside their chunk through a window over
    ``keys + chunk``; the first row of each chunk takes the last row of the chunk before,
    from a table of one row per (key, chunk).  ``columns`` maps source to output names.
    NULL keys and chunks are values like any other.
    """
    keys, order = list(keys), list(order)
    sources = list(columns)
    chunked = df.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    packed = F.struct(*[F.col(c) for c in sources])
    lagged = (chunked.withColumn("__prev", F.lag(packed).over(inside))
              .withColumn("__head", F.row_number().over(inside) == 1))
    tails = chunked.groupBy(*keys, "__chunk").agg(
        F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("__tail"))
    across = Window.partitionBy(*keys).orderBy("__chunk")
    tails = tails.withColumn("__carry", F.lag("__tail").over(across)).drop("__tail")
    joined = join_nulls(lagged, tails, [*keys, "__chunk"], "left")
    prev = F.when(F.col("__head"), F.col("__carry")).otherwise(F.col("__prev"))
    joined = joined.withColumn("__p", prev)
    for source, out in columns.items():
        joined = joined.withColumn(out, F.col(f"__p.{source}"))
    return joined.drop("__p", "__prev", "__carry", "__head", "__chunk")


def running_sums(df: DataFrame, keys: Sequence[str], order: Column, chunk: Column, sums: Mapping[str, str]) -> DataFrame:
    """Cumulative sums (inclusive) in ``order`` for groups of any size.

    ``chunk`` must not decrease along ``order``: sums run inside (key, chunk) and are lifted
    by the totals of the chunks before, a table of one row per key and chunk.  ``sums`` maps
    source to output column names; ``order`` should be unique per key.  NULL is a key like any other.
    """
    keys = list(keys)
    chunked = df.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order)
    local = chunked.withColumns({f"__in_{s}": F.sum(s).over(inside) for s in sums})
    totals = chunked.groupBy(*keys, "__chunk").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    across = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__chunk", *[F.coalesce(F.sum(f"__t_{s}").over(across), F.lit(0)).alias(f"__b_{s}") for s in sums])
    out = join_nulls(local, totals, [*keys, "__chunk"])
    return (out.withColumns({name: F.col(f"__in_{s}") + F.col(f"__b_{s}") for s, name in sums.items()})
            .drop("__chunk", *[f"__{p}_{s}" for s in sums for p in ("in", "b")]))
