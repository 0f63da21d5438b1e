"""Numpy steps over whole groups: sorted partitions cut into blocks of complete groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of whole groups that one numpy step works on.
BLOCK_ROWS = 65_536
#: Rows that a task of ``spread`` gets at most, keys permitting.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, keys: Sequence[str], grown: int = 1) -> DataFrame:
    """Rows of equal ``keys`` in one partition, as many partitions as the (counted) rows ask for.

    Groups by these and further columns then need no other shuffle, and their tasks hold as much of a large table as of a small
    one.  ``grown`` is how many rows each row is to become.
    """
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks_for(df, grown) or shuffled, *keys)


def tasks_for(df: DataFrame, grown: int = 1) -> int | None:
    """Tasks that the (counted) rows ask for beyond the session's shuffle partitions; None where those suffice."""
    tasks = -(-df.count() * grown // TASK_ROWS)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def in_tasks(df: DataFrame, tasks: int | None, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` in one of ``tasks`` partitions; unchanged without a number."""
    return df if tasks is None else df.repartition(tasks, *keys)


def changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True at rows whose keys differ from those of the row before; NULL equals NULL."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column.slice(0, max(len(column) - 1, 0)), column.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def map_blocks(df: DataFrame, keys: Sequence[str], step: Callable[[pa.Table, np.ndarray], pa.Table], schema: str,
               order: Sequence[str] = (), rows: int = BLOCK_ROWS, tasks: int | None = None) -> DataFrame:
    """Apply ``step(table, starts)`` to blocks of complete groups of ``keys``, sorted by keys and ``order``.

    ``starts`` marks the first row of each group.  One shuffle; a task holds at least ``rows`` rows or one
    group, so a group must have a bound of its own (a site's calendar, a raster's row).  ``tasks`` as of ``tasks_for``.
    """
    keys = list(keys)
    laid = (in_tasks(df, tasks, keys) if tasks and keys else df.repartition(*keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= rows:
                table = pa.Table.from_batches(held)
                new = changes(table, keys)
                last = int(np.flatnonzero(new)[-1])
                if last:
                    yield from step(table.slice(0, last), new[:last]).to_batches()
                held, n = table.slice(last).to_batches(), len(table) - last
        if n:
            table = pa.Table.from_batches(held)
            yield from step(table, changes(table, keys)).to_batches()

    return laid.mapInArrow(run, schema)
