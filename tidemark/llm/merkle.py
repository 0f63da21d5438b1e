"""Merkle dataset manifest: leaves and required outer nodes are cogrouped by superblock.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else byte count, ``:`` and value.
Leaves of a group (``lang``) stand in order of the key; two consecutive nodes (a last one alone)
become the hash of their hexadecimal digests until one remains, the group's subroot.  Subroots,
in order of the group, give the root the same way.

``BLOCK`` levels make a superblock of at most 1,024 nodes, the only unit that a task ever holds:

1. going up, each superblock becomes one node of the next level, until one node is left;
2. coming down, the nodes of a level are cogrouped with the outer path of their superblock, which
   gives the outer path of each of them;
3. at the leaves the same cogroup rebuilds the superblock, joins the inner and the outer siblings
   into proofs and folds the given, possibly altered leaves up to the root.

Results for odd input: a null key or group comes first; rows with equal key and group stand in order
of their leaf, so the digests do not depend on the order of reading; repeated rows are leaves of their
own; an empty table gives no rows; columns other than the named ones are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import join_counted, numbered, stored

#: Levels of a superblock: 2 ** BLOCK nodes at most.
BLOCK = 10

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUTER = "g long, idx long, sides string, siblings array<string>, subroot string, root string"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _h(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], n: int, block: int) -> list[list[str]]:
    """The nodes of a superblock level by level; ``n`` nodes of its level in the whole group decide where it ends."""
    out = [nodes]
    for _ in range(min(block, max(n - 1, 0).bit_length())):
        below = out[-1]
        out.append([_h(below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def _path(levels: list[list[str]], at: int) -> tuple[str, list[str]]:
    """Side of the sibling at each level (L, R, or - for none) and the siblings."""
    sides, siblings = [], []
    for level in levels[:-1]:
        other = at ^ 1
        if other < len(level):
            sides.append("L" if other < at else "R")
            siblings.append(level[other])
        else:
            sides.append("-")
        at >>= 1
    return "".join(sides), siblings


def fold(leaf: str, sides: str, siblings: Iterable[str]) -> str:
    """The node that a leaf and its siblings lead to."""
    rest = iter(siblings)
    for side in sides:
        leaf = _h((leaf,)) if side == "-" else _h((next(rest), leaf)) if side == "L" else _h((leaf, next(rest)))
    return leaf


def _up(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        top = _levels(pdf["hash"].tolist(), n, block)[-1]
        at = int(pdf["idx"].iloc[0]) >> block
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "idx": [at], "n": [-(-n >> block)], "hash": top})
    return run


def _climb(nodes: DataFrame, block: int) -> list[DataFrame]:
    """Levels of superblocks above ``nodes`` (g, idx, n, hash), up to one node per group."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        keyed = out[-1].withColumn("_block", F.shiftright("idx", block))
        out.append(stored(keyed.groupBy("g", "_block").applyInPandas(_up(block), nodes.select("g", "idx", "n", "hash").schema), "nodes"))
        most = -(-most >> block)
    return out


def _down(block: int, own_subroot: bool):
    """Outer paths of the nodes of one superblock; nodes that are subroots say so."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        above = outer.iloc[0]
        levels = _levels(nodes["hash"].tolist(), int(nodes["n"].iloc[0]), block)
        rows = []
        for at, (idx, own) in enumerate(zip(nodes["idx"].tolist(), nodes["hash"].tolist(), strict=True)):
            sides, siblings = _path(levels, at)
            rows.append((int(nodes["g"].iloc[0]), idx, sides + above["sides"], siblings + list(above["siblings"]), own if own_subroot else above["subroot"], above["root"]))
        return pd.DataFrame(rows, columns=["g", "idx", "sides", "siblings", "subroot", "root"])
    return run


def _descend(levels: list[DataFrame], outer: DataFrame, block: int, subroots: bool = False) -> DataFrame:
    """Outer paths of the nodes of ``levels[0]``, from those of the one node above each group."""
    for k in range(len(levels) - 2, -1, -1):
        keyed = levels[k].withColumn("_block", F.shiftright("idx", block))
        given = outer.withColumn("_block", F.col("idx"))
        outer = stored(keyed.groupBy("g", "_block").cogroup(given.groupBy("g", "_block")).applyInPandas(_down(block, subroots and k == 0), OUTER), "outer")
    return outer


def _prove(block: int):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("idx")
        own = leaves["hash"].tolist()
        levels = _levels(own, int(leaves["n"].iloc[0]), block)
        above = outer.iloc[0]
        beyond, rest, known = above["sides"], list(above["siblings"]), {}
        out = {"leaf": own, "sides": [], "siblings": [], "folded_root": []}
        for at, given in enumerate(leaves["given"].tolist()):
            sides, siblings = _path(levels, at)
            inner = fold(given, sides, siblings)
            if inner not in known:
                known[inner] = fold(inner, beyond, rest)
            out["sides"].append(sides + beyond)
            out["siblings"].append(siblings + rest)
            out["folded_root"].append(known[inner])
        return pd.DataFrame({"key": leaves["key"], **out, "subroot": above["subroot"], "root": above["root"]})
    return run


def _trees(docs: DataFrame, fields: Sequence[str], key: str, group: str, altered: dict[str, Column] | None, block: int):
    given = leaf_hash([(altered or {}).get(c, F.col(c)) for c in fields]) if altered else F.lit(None).cast("string")
    hashed = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf_hash([F.col(c) for c in fields]).alias("hash"), given.alias("given"))
    hashed = hashed.withColumn("given", F.nullif("given", "hash"))
    rows = numbered(hashed, ["grp"], ["key", "hash"], "leaves")
    groups = numbered(rows.where("rank = 0").select("grp", F.col("n").alias("size")), [], ["grp"], "groups")
    groups = stored(groups.select("grp", F.col("rank").alias("g"), F.col("n").alias("of"), "size"), "groups")
    return rows, groups


def _nodes(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return join_counted(rows, groups.select("grp", "g"), ["grp"]).select("key", "g", F.col("rank").alias("idx"), "n", "hash", F.coalesce("given", "hash").alias("given"))


def _top(levels: list[DataFrame], groups: DataFrame, block: int) -> list[DataFrame]:
    """Levels above the subroots."""
    subroots = levels[-1].join(groups.select("g", "of"), "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.col("of").alias("n"), "hash")
    return _climb(stored(subroots, "subroots"), block)


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang",
           altered: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: key, leaf, subroot, root, sides, siblings (leaf to root), folded_root.

    ``altered`` maps fields to expressions over ``docs`` that hold at checking time; their leaves are folded
    with the siblings of the unaltered tree.
    """
    rows, groups = _trees(docs, fields, key, group, altered, block)
    leaves = _nodes(rows, groups)
    levels = _climb(leaves.select("g", "idx", "n", "hash"), block)
    top = _top(levels, groups, block)
    root = top[-1].select("g", "idx", F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    outer = _descend(top, root, block, True).select(F.col("idx").alias("g"), F.lit(0).cast("long").alias("idx"), "sides", "siblings", "subroot", "root")
    outer = _descend(levels[1:], outer, block) if len(levels) > 1 else outer
    # the key travels as text: pandas would turn integers beside nulls into floating point
    keyed = leaves.withColumns({"_block": F.shiftright("idx", block), "key": F.col("key").cast("string")}).groupBy("g", "_block")
    given = outer.withColumn("_block", F.col("idx")).groupBy("g", "_block")
    out = keyed.cogroup(given).applyInPandas(_prove(block), "key string, leaf string, subroot string, root string, sides string, siblings array<string>, folded_root string")
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", block: int = BLOCK) -> DataFrame:
    """One row per group: group, n (leaves), subroot, root."""
    rows, groups = _trees(docs, fields, key, group, None, block)
    levels = _climb(_nodes(rows, groups).select("g", "idx", "n", "hash"), block)
    top = _top(levels, groups, block)
    root = top[-1].select(F.col("hash").alias("root"))
    named = groups.join(levels[-1].select("g", F.col("hash").alias("subroot")), "g").join(F.broadcast(root))
    return named.select(F.col("grp").alias(group), F.col("size").alias("n"), "subroot", "root")


def tampered_proofs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The digests of ``proofs`` where every row whose key's checksum 7 divides has one character more than it says."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n = F.col("n_chars").cast("decimal(38,0)")
    told = proofs(docs, altered={"n_chars": F.when(hit, n + 1).otherwise(n)}, block=block)
    return told.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
