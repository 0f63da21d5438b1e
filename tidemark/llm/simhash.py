"""SimHash near-dedup through the segment-popcount embedding.

A fingerprint of 64 bits maps to the bit counts of its 16 four-bit segments.  The Manhattan
distance of two embeddings never exceeds the Hamming distance, so fingerprints within
``RADIUS`` = 2 bits lie within distance 2 on the grid of counts and share a grid point at
distance one or less from both.  Every distinct fingerprint names its own point and its
neighbours (33 at most); points named twice give candidate pairs, which are verified on all
bits.  A point with more than ``CELL`` members takes an exact linear way instead of pairs:
members that share a value with one bit flipped are within two bits of each other, and each
is linked to the smallest that shares it.  Links are contracted to components by alternating
star rounds until nothing changes.

Copies collapse to one fingerprint before anything is joined.  Null texts have no words:
fingerprint zero, linked like any other.  Null ids never name a component (a component of
null ids alone has a null id).  Repeated rows give repeated results.  An empty table gives
no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import join_counted, stored
from tidemark.llm.fmdedup import maybe_marked
from tidemark.llm.setjoin import set_facts, similar_links

SHINGLE = 3
SEED = 42
CELL = 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()               # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = np.array([digest(joined, SEED)], "<u8")
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[width - 1:].tolist(), strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k:k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """Columns id and fp (the 64 bits as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t, width) for k in range(0, batch.num_rows, 500) for t in batch.column(1).slice(k, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def popcounts(fp: Column) -> Column:
    """Bit counts of the sixteen segments, four bits each, packed in one long."""
    halves = []
    for half in (fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)):        # sums of whole longs could overflow
        two = half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))
        halves.append(two.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(two, 2).bitwiseAND(F.lit(0x33333333)))
    return F.shiftleft(halves[1], 32).bitwiseOR(halves[0])


def grid_points(counts: Column) -> Column:
    """The packed point and all points one step away (counts stay in 0..4)."""
    near = [counts]
    for k in range(16):
        digit = F.shiftrightunsigned(counts, 4 * k).bitwiseAND(F.lit(15).cast("long"))
        step = F.lit((1 << 4 * k) if 4 * k < 63 else 0).cast("long")
        near += [F.when(digit < 4, counts + step), F.when(digit > 0, counts - step)]
    return F.filter(F.array(*near), lambda x: x.isNotNull())


def embedded_points(fp: Column) -> Column:
    """A fingerprint's point on the grid of counts and the points next to it."""
    return grid_points(popcounts(fp))


def block_points(fp: Column) -> Column:
    """The 22, 21 and 21 bits of three blocks, numbered: fingerprints within two bits have one block in common."""
    middle = F.shiftrightunsigned(fp, 22).bitwiseAND(F.lit((1 << 21) - 1))
    return F.array(fp.bitwiseAND(F.lit((1 << 22) - 1)), middle + F.lit(1 << 22), F.shiftrightunsigned(fp, 43) + F.lit(2 << 22))


def close_links(distinct: DataFrame, cell: int = CELL, keys: tuple[str, ...] = (), points_of: Callable[[Column], Column] = embedded_points) -> DataFrame:
    """Links u > v between distinct fingerprints (columns ``keys``, fp; linked inside a key only): every pair
    within two bits is linked or, at crowded points, joined through a third within two bits of both.

    ``points_of`` gives points of which fingerprints within two bits have one in common."""
    k = list(keys)
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each row becomes several: spread the few small files first, or few tasks would aggregate all points.
    points = distinct.repartition(tasks, *k, "fp").select(*k, "fp", F.explode(points_of(F.col("fp"))).alias("point"))
    crowd = stored(points.groupBy(*k, "point").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "points")
    met = stored(points.join(crowd, [*k, "point"]), "met")
    few = met.where(F.col("m") <= cell).select(*k, "point", "fp")
    links = (few.withColumnRenamed("fp", "v").join(few.withColumnRenamed("fp", "u"), [*k, "point"])
             .where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select(*k, "u", "v"))
    crowded = met.where(F.col("m") > cell)
    if crowded.first() is not None:
        flips = [F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)]]
        many = (crowded.select(*k, "fp").distinct()
                .select(*k, F.col("fp").alias("u"), F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("flip")))
        least = many.groupBy(*k, "flip").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        links = links.unionByName(many.join(least, [*k, "flip"]).where("u > v").select(*k, "u", "v"))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node with a link: columns u, v (v < u).

    Large-star hangs the larger neighbours of a node on its smallest neighbour, small-star its
    smaller ones; the rounds end when the links no longer change.  Each round is stored.
    """
    edges, seen = stored(links, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            return edges
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").unionByName(least.select("u", F.col("low").alias("v"))).distinct()
        edges = stored(small, "links")


def grouped(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """``prints`` (id, fp and any others) with component_id, the smallest id reachable."""
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = components(close_links(classes.select("fp"), cell)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = stored(rooted.join(lowest, "root").select("fp", "component_id"), "components")
    return prints.join(known, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """Per document: id, fingerprint (16 hexadecimal digits), component_id."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "prints")
    return grouped(prints, cell).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- the pipeline's stage: five-word shingles, similarity 0.8 --------------------------------

SIMILAR = 0.8
WORDS = 5
ROUNDS = 4
#: Members, bytes of text and shingles of a group that one task settles.
MEMBERS = 1000
TEXT_BYTES = 8 << 20
SHINGLES = 1_000_000


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Distinct hashes of ``width`` lower-case words; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    got = {xxhash.xxh64_intdigest(b" ".join(words[j:j + width]), SEED) for j in range(max(1, len(words) - width + 1))}
    return np.fromiter(got, np.uint64, len(got)).view(np.int64)


def shingle_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """Columns key and shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = [shingle_set(text, width) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.mapInArrow(run, "key long, shingles array<long>")


def _similar(a: str, b: str):
    both = F.size(F.array_intersect(a, b))
    return both >= SIMILAR * (F.size(a) + F.size(b) - both)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (key, head and others) with ``same``, whether the two contents' shingles are similar."""
    return (pairs.join(sets.select("key", F.col("shingles").alias("a")).hint("merge"), "key")
            .join(sets.select(F.col("key").alias("head"), F.col("shingles").alias("b")).hint("merge"), "head")
            .withColumn("same", _similar("a", "b")).drop("a", "b"))


#: Large groups whose heads' shingles are broadcast.
HEADS = 500


def _judged(left: DataFrame, heads: DataFrame, sets: DataFrame) -> DataFrame:
    """``left`` (root, key, low) without the ``heads`` (root, head), with ``same``, whether a content is similar to its root's head."""
    known = stored(heads.join(sets.select(F.col("key").alias("head"), F.col("shingles").alias("b")), "head"), "heads")
    rows = left.join(sets.select("key", F.col("shingles").alias("a")).hint("merge"), "key")
    return join_counted(rows, known, ["root"], limit=HEADS).where("key != head").select("root", "key", "low", _similar("a", "b").alias("same"))


def _prefixes(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The shingles of ``left`` (root, key, low) by which similar members of a root must meet: root, token, key, low.

    Similar sets share four fifths of the larger one, so with one order of all shingles the first
    size - ceil(0.8 size) + 1 of both have one in common.  Rare ones come first, so that wording all members
    have meets nobody; a shingle that one member has takes its place in the order but meets nobody either.
    """
    tokens = left.join(sets.hint("merge"), "key").select("root", "key", "low", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("root", "token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    ranked = tokens.join(often.hint("merge"), ["root", "token"]).groupBy("root", "key", "low", "n").agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("shared"))
    lone = F.col("n") - F.size("shared")
    # A whole number is left out of the product's rounding: one token too many costs a comparison, one too few a pair.
    first = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILAR) - 1e-6).cast("int") + 1 - lone
    return ranked.where(first > 0).select("root", "key", "low", F.explode(F.slice("shared", F.lit(1), first)).alias("s")).select("root", "s.token", "key", "low")


def _greedy(t: pa.Table) -> pa.Table:
    """The members of one root that go, taken in the order of (low, key): columns key, low."""
    t = t.sort_by([("low", "ascending"), ("key", "ascending")])
    return _going(t, [np.sort(x.values.to_numpy()) for x in t.column("shingles")])


def _greedy_texts(t: pa.Table) -> pa.Table:
    """``_greedy`` from texts, where rows may repeat."""
    t = t.sort_by([("low", "ascending"), ("key", "ascending")])
    _, first = np.unique(t.column("key").to_numpy(), return_index=True)
    t = t.take(pa.array(np.sort(first)))
    return _going(t, [np.sort(shingle_set(x.as_py())) for x in t.column("text")])


def _going(t: pa.Table, sets: list[np.ndarray]) -> pa.Table:
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    met: dict[int, list[int]] = {}
    gone, at = [], 0
    for i, x in enumerate(sets):
        order = np.sort(rank[place[at:at + len(x)]])
        at += len(x)
        first = order[:len(x) - math.ceil(len(x) * SIMILAR - 1e-6) + 1].tolist()
        for j in {j for r in first for j in met.get(r, ())}:
            both = len(np.intersect1d(x, sets[j], assume_unique=True))
            if both >= SIMILAR * (len(x) + len(sets[j]) - both):
                gone.append(i)
                break
        else:
            for r in first:
                met.setdefault(r, []).append(i)
    return t.select(["key", "low"]).take(pa.array(gone, pa.int64()))


def _settled(left: DataFrame, sets: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Contents of ``left`` (root, key, low) that go, in the order of (low, key) in each root: columns key, low.

    A root of up to ``members`` members and ``SHINGLES`` shingles is settled in one task.  In a larger one a content
    that is the least at all its tokens has no smaller similar one left: it is kept and compared with those that
    meet it, turn by turn, until the root is small or no two members meet.
    """
    meet = gone = None
    while True:
        sized = stored(left.join(sets.select("key", F.size("shingles").alias("n")).hint("merge"), "key"), "left")
        roots = stored(sized.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).where("m > 1")
                       .select("root", ((F.col("m") <= members) & (F.col("n") <= SHINGLES)).alias("small")), "roots")
        few = sized.drop("n").join(roots.where("small").select("root"), "root", "left_semi")
        out = stored(few.join(sets.hint("merge"), "key").groupBy("root").applyInArrow(_greedy, "key long, low long"), "out")
        gone = out if gone is None else gone.unionByName(out)
        large = roots.where(~F.col("small")).select("root")
        if large.first() is None:
            return gone
        if meet is None:
            meet = stored(_prefixes(sized.drop("n").join(large, "root", "left_semi"), sets), "prefixes")
        meet = meet.join(large, "root", "left_semi")
        least = meet.groupBy("root", "token").agg(F.min(F.struct("low", "key")).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        met = stored(meet.join(least.hint("merge"), ["root", "token"]).select("root", "token", "key", "low", F.col("least.key").alias("head")), "met")
        kept = stored(met.groupBy("key").agg(F.bool_and(F.col("key") == F.col("head")).alias("all")).where("all").select("key"), "kept")
        pairs = met.where("key != head").select("key", "low", "head").distinct().join(kept.select(F.col("key").alias("head")).hint("merge"), "head", "left_semi")
        out = stored(_compared(pairs, sets).where("same").select("key", "low").distinct(), "out")
        gone = gone.unionByName(out)
        meet = stored(met.join(kept.unionByName(out.select("key")).hint("merge"), "key", "left_anti").select("root", "token", "key", "low"), "prefixes")
        left = meet.select("root", "key", "low").distinct()


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, members: int = MEMBERS) -> DataFrame:
    """The rows of ``docs`` with one document (the smallest id) of each group of copies and near copies.

    Groups hold every pair of texts whose five-word shingles have a Jaccard similarity of 0.8 or more (``similar_links``);
    in order of their ids a text goes if it is that similar to a smaller one that is kept, so no two similar ones stay.
    Groups of up to ``members`` members and ``TEXT_BYTES`` are settled in one task each.  In larger ones
    ``rounds`` rounds compare all with the smallest id left, which settles groups of few families
    at once; what is left of a group meets by shingles, however many families it has.
    Texts are shuffled only if a filter of fixed size holds their row: once as members of a group, once as
    rows that go or are repeated.  Joins whose sides grow with the documents are merge joins, so the driver holds none of them.
    Rows with a null id stay; of rows that repeat an id and a text one stays.
    """
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))          # packed, so any column name may occur
    known = base.where(F.col("id").isNotNull()).select("id", "key", "text")
    facts = stored(set_facts(known), "facts")
    contents = stored(facts.groupBy("key").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("bytes", "n", "sketch")]), "contents")
    gone = facts.select("id", "key").join(contents.select("key", "low").hint("merge"), "key").where("id != low").select("id", "key")
    roots = components(stored(similar_links(known, contents), "links")).select(F.col("u").alias("key"), F.col("v").alias("root"))
    linked = roots.unionByName(roots.select(F.col("root").alias("key"), "root")).distinct()
    left = stored(contents.select("key", "low", "bytes").join(linked.hint("merge"), "key"), "members")
    linked_texts = known.where(maybe_marked(left.select(F.col("low").alias("id"), "key")))
    sized = left.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
    sized = stored(sized.select("root", ((F.col("m") <= members) & (F.col("bytes") <= TEXT_BYTES)).alias("small")), "roots")
    few, left = [left.drop("bytes").join(sized.where(which).select("root").hint("merge"), "root", "left_semi") for which in (F.col("small"), ~F.col("small"))]
    # Texts are a fraction of their shingles' hashes: groups that one task settles meet as texts, in one shuffle.
    texts = linked_texts.join(few.withColumnRenamed("low", "id").hint("merge"), ["key", "id"]).select("root", "key", F.col("id").alias("low"), "text")
    settled = stored(texts.groupBy("root").applyInArrow(_greedy_texts, "key long, low long"), "settled")
    gone = gone.unionByName(settled.select(F.col("low").alias("id"), "key"))
    if not sized.where(~F.col("small")).isEmpty():
        left = stored(left, "left")
        wanted = left.select("key", F.col("low").alias("id"))
        sets = stored(shingle_sets(linked_texts.join(wanted.hint("merge"), ["key", "id"], "left_semi").select("key", "text")).dropDuplicates(["key"]), "shingles")
        for _ in range(rounds):
            heads = stored(left.groupBy("root").agg(F.min(F.struct("low", "key")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
                           .select("root", F.col("head.key").alias("head")), "heads")
            if heads.first() is None:
                break
            judged = stored(_judged(left, heads, sets), "judged")
            gone = gone.unionByName(judged.where("same").select(F.col("low").alias("id"), "key"))
            left = judged.where(~F.col("same")).select("root", "key", "low")
        several = left.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        left = stored(left.join(several, "root", "left_semi"), "left")
        if left.first() is not None:
            gone = gone.unionByName(_settled(left, sets, members).select(F.col("low").alias("id"), "key"))
    gone = stored(gone.distinct(), "gone")
    repeated = stored(facts.groupBy("id", "key").count().where("count > 1").select("id", "key"), "repeated")
    rows = base.select("row", "id", "key").withColumn("maybe", maybe_marked(gone.unionByName(repeated)) & F.col("id").isNotNull())
    met = rows.where("maybe").select("row", "id", "key").join(gone.hint("merge"), ["id", "key"], "left_anti").dropDuplicates(["id", "key"])
    return rows.where(~F.col("maybe")).select("row").unionByName(met.select("row")).select("row.*")
