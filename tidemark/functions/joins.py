"""Joins on keys that may be NULL, and joins of a large table with a table of few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Rows and bytes (as JSON) up to which the small side is broadcast; both are counted, not assumed.
SMALL_ROWS, SMALL_BYTES = 100_000, 64 << 20


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where NULL equals NULL; an equi-join to the optimiser.

    For inner, left, left_semi and left_anti joins; the keys come out once, from the left side.
    """
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = SMALL_ROWS) -> DataFrame:
    """Join ``df`` with an aggregate of a few rows per key, without shuffling ``df`` on those keys.

    Aggregates over a handful of keys look as large as their input to the optimiser, and a
    shuffle on such keys puts whole areas into single tasks.  The small side is computed
    once, its rows and bytes are counted, and it is broadcast if both are within their limits;
    otherwise the join is an ordinary one.  NULL keys meet NULL keys.
    """
    held = cut_lineage(small)
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in held.columns]))))
    rows, width = held.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return join_nulls(df, F.broadcast(held) if rows <= limit and width <= SMALL_BYTES else held, keys, how)
