"""Mixing sources to target weights by weighted fair queueing.

Sources take weights 1, 2, 3, repeating, in code-point order (null last) and share the sum of
all sizes; a target stops at three times its source's size and the excess is shared again by
weight until none is above.  Documents are shuffled within their source by a digest of their
id; the n-th copy of a document (three at most) has the virtual finish time

    (words of earlier copies and documents of the source + its own) / target.

All copies are range-sorted by that time and served to the total budget, which is reached at
time one: a document in service then gives the words served so far, so that each source meets
its target to a word.  Cumulative sums run in chunks of a source (first digits of the digest)
and of time, so a source with a third of all rows spreads over all tasks.

Null texts have size 0 and are never taken; a null source is a source; null ids shuffle as the
word "null"; rows that repeat an id each count; an empty table gives no rows; columns other
than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import running_sums
from tidemark.llm.base import stored
from tidemark.llm.words import word_count

MOST_COPIES = 3


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, rank, source_size, target."""
    named = (sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({
        "name": F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))), "one": F.lit(1).cast("long")}))
    ranked = running_sums(named, [], F.col("name"), F.substring("name", 1, 3), {"one": "rank"})
    s = stored(ranked.select("source", "source_size", "rank", ((F.col("rank") - 1) % cycle + 1).alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    budget = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = None, -1
    while True:                                                   # the level only rises: every round caps one more source or is the last
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        fixed, weights, count = s.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
                                      F.coalesce(F.sum(over.cast("long")), F.lit(0))).first()
        if count == capped or not weights:
            break
        level, capped = (budget - fixed) / weights, count
    if level is None:
        level = 0.0
    over = F.lit(level) * F.col("weight") > F.col("cap")
    return s.select("source", "rank", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix_plan(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (row, id, source, size, stored) to copies in mix order: row, copy, finish, served, mix_end."""
    targets = stored(source_targets(sizes), "targets")
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = targets.withColumnRenamed("source", "t_source")
    rows = (sizes.join(own, sizes["source"].eqNullSafe(own["t_source"])).drop("t_source")
            .withColumn("draw", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary"))))
    order = F.struct("draw", "id", "size", "row")
    queued = stored(running_sums(rows, ["rank"], order, F.substring("draw", 1, 4), {"size": "upto"}), "queued")
    copies = (queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .withColumn("end", F.col("copy") * F.col("source_size") + F.col("upto"))
              .where((F.col("size") > 0) & (F.col("end") - F.col("size") < F.col("target"))))
    served = copies.select("row", "rank", "copy", "draw", (F.col("end") / F.col("target")).alias("finish"),
                           F.least(F.col("size"), F.floor(F.col("target")) - (F.col("end") - F.col("size"))).cast("long").alias("served"))
    mixed = running_sums(served, [], F.struct("finish", "rank", "draw", "copy", "row"), F.floor(F.col("finish") * 4096), {"served": "mix_end"})
    left = F.lit(budget) - (F.col("mix_end") - F.col("served"))
    return mixed.select("row", "copy", "finish", F.greatest(F.least("served", left), F.lit(0)).cast("long").alias("served"), "mix_end")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target of its source, words taken."""
    sizes = _sizes(docs, id_col, text_col, source_col)
    taken = mix_plan(sizes).groupBy("row").agg(F.sum("served").alias("taken"))
    targets = source_targets(sizes).withColumnRenamed("source", "t_source")
    rows = sizes.join(taken, "row", "left")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["t_source"]))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` once per copy that the mix takes; a copy cut by the budget stays if at least half of it is served.

    Rows that repeat an id and a text share their copies evenly, rounded.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    plan = mix_plan(sizes).withColumnRenamed("row", "p_row")
    whole = (sizes.join(plan, sizes["row"] == plan["p_row"], "left")
             .groupBy("id", "key").agg(F.sum(F.when(2 * F.col("served") >= F.col("size"), 1).otherwise(0)).alias("copies"), F.count_distinct("row").alias("rows")))
    whole = stored(whole.where("copies > 0").select(F.col("id").alias("w_id"), F.col("key").alias("w_key"), F.round(F.col("copies") / F.col("rows")).cast("int").alias("copies")), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),      # packed, so any column name may occur
                       F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("key"))
    joined = rows.join(whole, rows["id"].eqNullSafe(whole["w_id"]) & (rows["key"] == whole["w_key"]))
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
