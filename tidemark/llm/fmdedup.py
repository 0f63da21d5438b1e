"""Substring dedup by a compressed FM-index per shard.

A window is ``window`` consecutive words of one document; a word goes if a window that
covers it also starts in a document with a smaller id.  Shards are cut by content, so that
equal windows meet in one shard, however many documents there are:

1. every window names its minimizer, the smallest hash among its ``GRAM``-word grams; runs of
   windows with one minimizer form a segment (at most 2 * window - GRAM words);
2. grams that only one document uses cannot be part of a repeat: hashes, smallest and largest
   id and counts are combined per task and per hash range.  Shared grams set bits of a filter
   of fixed size; where two grams meet in one bit, more segments go on than need to, and no
   result changes.  A second filter marks grams of over ``HOT_SEGMENTS`` segments;
3. distinct segments of a task (with smallest and largest id) are dealt to shards by gram,
   those of marked grams window by window, packed and compressed.  Each shard builds an
   FM-index (suffix array by doubling, wavelet matrix over the transform, rank blocks) and
   streams its segments through backward search: the matching statistic of each place, up to
   the threshold, and the smallest id inside the suffix interval of every full match;
4. occurrences, one row per task and segment, look up their segment's result; windows first
   seen under a smaller id are marked.  Only texts whose bit is set in a filter of the marked
   rows meet their marks in a join; all others are finished where they are read.

Both filters have one size whatever the input, and there is no other way beside this one.

Segments count as equal if their gram and content hashes (64 bits each) agree; inside a shard
windows are compared as words.  Null texts have no words.  Rows with a null id neither lose words nor cause a loss.  Rows that
repeat an id are judged each on its own text and never against each other.  An empty table
gives no rows; columns other than id and text may have any name and are passed on unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import mix64, slices, span_hashes, stored, utf8_parts, word_spans

WINDOW = 13
GRAM = 6
#: Bits of the filters over shared grams (64 MB), hot grams (1 MB) and marked rows (8 MB).
SHARED_BITS = 29
HOT_BITS = 23
MARK_BITS = 26
HOT_SEGMENTS = 10_000
#: Occurrences, and so distinct segments at most, for which one shard is planned.
SHARD_SEGMENTS = 40_000
FLUSH = 1_000_000
FLUSH_BYTES = 32 << 20
OCCURRENCES = 4096
PLACE = np.dtype([("id", "<i8"), ("key", "<i8"), ("place", "<i4")])


def window_minimizers(word_hash: np.ndarray, row: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the place of each one's minimizer, and the hash of every gram.

    The leftmost smallest gram wins, which depends on the window's words alone.
    """
    n = len(word_hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + word_hash[k:n - gram + 1 + k]
    grams = mix64(grams)
    width = window - gram + 1
    best, span = np.arange(len(grams)), 1
    while span < width:                                          # sliding minimum by growing spans
        step = min(span, width - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        span += step
    first = np.flatnonzero(row[window - 1:] == row[:n - window + 1])
    return first, best[first], grams


class FMIndex:
    """FM-index of several word sequences; sequence ends are separators no query can hold."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """``symbols`` (1..s) of all sequences end to end, ``lengths`` of the sequences."""
        count, n = len(lengths), len(symbols) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        words = np.ones(n, bool)
        words[ends] = False
        text[words] = symbols
        rank = text + count - 1
        rank[ends] = np.arange(count)                            # separators differ, so ties end
        step = 1
        while True:
            following = np.zeros(n, np.int64)
            following[:n - step] = rank[step:] + 1
            key = rank * (n + count + int(symbols.max(initial=0)) + 2) + following
            order = np.argsort(key, kind="stable")
            changed = np.empty(n, np.int64)
            changed[0] = 0
            np.cumsum(key[order[1:]] != key[order[:-1]], out=changed[1:])
            rank = np.empty(n, np.int64)
            rank[order] = changed
            if n == 0 or changed[-1] == n - 1:
                break
            step *= 2
        self.order, self.text, self.n = order, text, n
        self.sequence = np.repeat(np.arange(count), lengths + 1)
        top = int(text.max(initial=0))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels = []
        column = text[order - 1]                                 # the transform
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            on = ((column >> bit) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bits = np.packbits(on, bitorder="little")
            packed[:len(bits)] = bits
            blocks = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).astype(np.int64))])[:-1]
            self.levels.append((bit, blocks, before, int(n - on.sum())))
            column = np.concatenate([column[~on], column[on]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``upto`` places of the transform."""
        low = np.zeros_like(upto)
        for bit, blocks, before, zeros in self.levels:
            on = ((symbol >> bit) & 1).astype(bool)
            moved = []
            for at in (low, upto):
                ones = before[at >> 6] + np.bitwise_count(blocks[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
                moved.append(np.where(on, zeros + ones, at - ones))
            low, upto = moved
        return upto - low

    def matching_statistics(self, query: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match, up to ``threshold``, that ends before each of ``ends`` in ``query``; its suffix interval.

        ``query`` uses the index's symbols, 0 for words it lacks and between documents.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        for step in range(1, threshold + 1):
            active = active[ends[active] - step >= 0]
            symbol = query[ends[active] - step]
            active, symbol = active[symbol > 0], symbol[symbol > 0]
            if not len(active):
                break
            a = self.smaller[symbol] + self.rank(symbol, low[active])
            b = self.smaller[symbol] + self.rank(symbol, high[active])
            found = b > a
            active = active[found]
            low[active], high[active], length[active] = a[found], b[found], step
        return length, low, high


def _segments_of(raw: np.ndarray, at: np.ndarray, window: int):
    """Segments of texts laid end to end: gram hash, first word, last word, words' bytes and rows."""
    start, end, row = word_spans(raw, at)
    hashes = span_hashes(raw, start, end)
    first, best, grams = window_minimizers(hashes, row, window)
    if not len(first):
        return None
    new = np.ones(len(first), bool)
    new[1:] = (best[1:] != best[:-1]) | (first[1:] != first[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(first)) - 1
    return grams[best[head]], first[head], first[tail] + window - 1, start, end, row, hashes


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, compressed: sorted hashes and near ids shrink that way."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(blob: memoryview, *kinds: str) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(pa.py_buffer(blob[8:]), size, asbytes=True), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = size // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    """Hash whose first bits choose range and filter bit; minimizers themselves are crowded at small values."""
    return mix64(h + np.uint64(0x9E3779B97F4A7C15))


def _slice(h: np.ndarray, bits: int, ranges: int) -> bytes:
    """The part of a filter of 2 ** ``bits`` bits that belongs to one of 2 ** ``ranges`` ranges."""
    on = np.zeros(1 << (bits - ranges), np.uint8)
    on[(h >> np.uint64(64 - bits)) & np.uint64(len(on) - 1)] = 1
    return _pack(np.packbits(on, bitorder="little"))


def _filter(rows, bits: int, ranges: int) -> np.ndarray:
    """All slices (range, bytes) in place; ranges without a row stay empty."""
    whole = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - 3 - ranges)
    for k, blob in rows:
        whole[k * width:(k + 1) * width] = _unpack(memoryview(blob), "u1")[0]
    return whole


def _set(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _ranges(spark, bits: int) -> int:
    return min(bits - 3, (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def gram_filters(docs: DataFrame, window: int, hot_segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters of the grams that stand in two documents or more and of the hot ones, and how many segments
    they have (columns of ``docs``: id, text).  What reaches the driver is bounded by the filters' size."""
    ranges = _ranges(docs.sparkSession, HOT_BITS)
    kinds = ("<u8", "<i8", "<i8", "<i8")

    def combine(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        gram, low, high, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, low, high, n = gram[order], low[order], high[order], n[order]
        cut = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[:len(gram)])
        if not len(cut):
            return [gram, low, high, n]
        return [gram[cut], np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.add.reduceat(n, cut)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            rows = combine(parts)
            part = (_spread(rows[0]) >> np.uint64(64 - ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            names, cut = np.unique(part[order], return_index=True)
            gram, low, high, n = (x[order] for x in rows)
            pieces = [_pack(gram[a:b], low[a:b], high[a:b] - low[a:b], n[a:b]) for a, b in zip(cut, np.append(cut[1:], len(gram)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(pieces, pa.binary())], ["part", "rows"])

        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8_parts(batch.column(1))
            for a, b in slices(offsets):
                found = _segments_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], window)
                if found is None:
                    continue
                own = ids[a:b][found[5][found[1]]]
                parts.append(combine([[found[0], own, own, np.ones(len(own), np.int64)]]))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    def decide(t: pa.Table) -> pa.Table:
        parts = []
        for blob in t.column("rows"):
            gram, low, more, n = _unpack(memoryview(blob.as_buffer()), *kinds)
            parts.append([gram, low, low + more, n])
        gram, low, high, n = combine(parts)
        shared = low < high
        h, n = _spread(gram[shared]), n[shared]
        hot = n > hot_segments
        total = int(n[~hot].sum() + (window - GRAM + 1) * n[hot].sum())
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "shared": pa.array([_slice(h, SHARED_BITS, ranges)], pa.binary()),
                         "hot": pa.array([_slice(h[hot], HOT_BITS, ranges)], pa.binary()), "n": pa.array([total], pa.int64())})

    found = docs.mapInArrow(gather, "part int, rows binary").groupBy("part").applyInArrow(decide, "part int, shared binary, hot binary, n long").toArrow()
    part = found.column("part").to_pylist()
    return (_filter(zip(part, (x.as_buffer() for x in found.column("shared")), strict=True), SHARED_BITS, ranges),
            _filter(zip(part, (x.as_buffer() for x in found.column("hot")), strict=True), HOT_BITS, ranges), sum(found.column("n").to_pylist()))


def mark_filter(marks: DataFrame) -> np.ndarray:
    """Filter of the rows (id, key) in ``marks``."""
    ranges = _ranges(marks.sparkSession, MARK_BITS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.sort(batch.column(0).to_numpy().view(np.uint64))
            names, cut = np.unique((h >> np.uint64(64 - ranges)).astype(np.int32), return_index=True)
            pieces = [_pack(h[a:b]) for a, b in zip(cut, np.append(cut[1:], len(h)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pieces, pa.binary())], ["part", "rows"])

    def decide(t: pa.Table) -> pa.Table:
        h = np.concatenate([_unpack(memoryview(x.as_buffer()), "<u8")[0] for x in t.column("rows")])
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "bits": pa.array([_slice(h, MARK_BITS, ranges)], pa.binary())})

    rows = marks.select(_row_hash("id", "key").alias("h")).mapInArrow(gather, "part int, rows binary").groupBy("part").applyInArrow(decide, "part int, bits binary").toArrow()
    return _filter(zip(rows.column("part").to_pylist(), (x.as_buffer() for x in rows.column("bits")), strict=True), MARK_BITS, ranges)


def _row_hash(id_col: str, key_col: str):
    return F.xxhash64(id_col, key_col)


def maybe_marked(marks: DataFrame) -> Column:
    """Whether a row (columns id, key) may be in ``marks`` (id, key, stored): rows in it are never missed."""
    marked = marks.sparkSession.sparkContext.broadcast(mark_filter(marks))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(_set(marked.value, MARK_BITS, h.to_numpy().view(np.uint64)))

    return maybe(_row_hash("id", "key"))


def segments(docs: DataFrame, window: int, filters, shards: int) -> DataFrame:
    """Two kinds of rows: packed distinct segments for a shard (shard, blob), and the occurrences of a segment
    (gram, content, places: id, row key and first word of each); both combined over what a task holds at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = filters.value
        names = ["shard", "blob", "gram", "content", "places"]

        def flush(parts: list, words: list[bytes], fresh: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            gram, content, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(content, kind="stable")
            gram, content, place = gram[order], content[order], place[order]
            new = np.append(True, content[1:] != content[:-1])
            cut = np.flatnonzero(new)
            low, high = np.minimum.reduceat(place["id"], cut), np.maximum.reduceat(place["id"], cut)
            where = np.arange(len(content)) - np.repeat(cut, np.diff(np.append(cut, len(content))))
            piece = np.flatnonzero(where % OCCURRENCES == 0)
            ends = np.append(piece, len(content)).astype(np.int32) * PLACE.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(ends), pa.py_buffer(place.tobytes())])
            none = pa.nulls(len(piece), pa.int32()), pa.nulls(len(piece), pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(gram[piece].view(np.int64)), pa.array(content[piece].view(np.int64)), packed], names)
            text = [words[k] for k in np.argsort(np.concatenate(fresh), kind="stable").tolist()]          # one per distinct content
            gram, content, part = gram[cut], content[cut], np.zeros(len(cut), np.int32)
            deal = _spread(gram)
            cold, split = ~_set(hot, HOT_BITS, deal), []
            for k in np.flatnonzero(~cold).tolist():                                                     # hot grams: window by window
                w = text[k].split(b" ")
                split += [(k, i, b" ".join(w[i:i + window])) for i in range(len(w) - window + 1)]
            source = np.concatenate([np.flatnonzero(cold), np.array([x[0] for x in split], np.int64)])
            part = np.concatenate([part[cold], np.array([x[1] for x in split], np.int32)])
            deal = np.concatenate([deal[cold], mix64(deal[[x[0] for x in split]] ^ np.array([xxhash.xxh64_intdigest(x[2]) for x in split], np.uint64))]) if split else deal
            text = [text[k] for k in np.flatnonzero(cold).tolist()] + [x[2] for x in split]
            shard = (deal % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((part, content[source], gram[source], shard))
            source, part, shard = source[order], part[order], shard[order]
            text = [text[k] for k in order.tolist()]
            numbers, first = np.unique(shard, return_index=True)
            blobs = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(source)], strict=True):
                at = source[a:b]
                fixed = _pack(gram[at], content[at], low[at], high[at] - low[at], part[a:b])
                blobs.append(len(fixed).to_bytes(8, "little") + fixed + _pack(np.frombuffer(b"\n".join(text[a:b]), np.uint8)))
            rest = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blobs, pa.binary()), rest, rest, pa.nulls(len(blobs), pa.binary())], names)

        parts, words, fresh, seen, held, size = [], [], [], np.zeros(0, np.uint64), 0, 0
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = utf8_parts(batch.column(2))
            for a, b in slices(offsets):
                raw = data[offsets[a]:offsets[b]]
                found = _segments_of(raw, offsets[a:b + 1] - offsets[a], window)
                if found is None:
                    continue
                gram, first, last, start, end, row, hashes = found
                hit = _set(shared, SHARED_BITS, _spread(gram))
                gram, first, last = gram[hit], first[hit], last[hit]
                if not len(gram):
                    continue
                content = np.zeros(len(gram), np.uint64)
                for k in range(2 * window - GRAM):
                    inside = first + k <= last
                    content[inside] = mix64(content[inside] + hashes[first[inside] + k]) * np.uint64(0xD6E8FEB86659FD93)
                kinds, once = np.unique(content, return_index=True)
                unseen = ~np.isin(kinds, seen, assume_unique=True)
                fresh.append(kinds[unseen])
                body = raw.tobytes()
                for k in once[unseen].tolist():
                    words.append(b" ".join(body[start[first[k]]:end[last[k]]].split()))
                    size += len(words[-1]) + 40
                seen = np.union1d(seen, kinds[unseen])
                place = np.empty(len(gram), PLACE)
                origin = row[first]
                place["id"], place["key"] = ids[a:b][origin], keys[a:b][origin]
                place["place"] = first - np.searchsorted(row, origin, "left")
                parts.append((gram, content, place))
                held += len(gram)
                if held >= FLUSH or size >= FLUSH_BYTES:
                    yield from flush(parts, words, fresh)
                    parts, words, fresh, seen, held, size = [], [], [], np.zeros(0, np.uint64), 0, 0
        if held:
            yield from flush(parts, words, fresh)

    return docs.select("id", "key", "text").mapInArrow(run, "shard int, blob binary, gram long, content long, places binary")


def _shard(window: int):
    def run(t: pa.Table) -> pa.Table:
        columns, texts = [], []
        for blob in t.column("blob"):
            view = memoryview(blob.as_buffer())
            size = int.from_bytes(view[:8], "little")
            columns.append(_unpack(view[8:8 + size], "<u8", "<u8", "<i8", "<i8", "<i4"))
            texts += _unpack(view[8 + size:], "u1")[0].tobytes().split(b"\n")
        gram, content, low, more, part = (np.concatenate(x) for x in zip(*columns, strict=True))
        high = low + more
        order = np.lexsort((part, content, gram))
        same = (gram[order][1:] == gram[order][:-1]) & (content[order][1:] == content[order][:-1]) & (part[order][1:] == part[order][:-1])
        cut = np.flatnonzero(np.append(True, ~same))
        low, high = np.minimum.reduceat(low[order], cut), np.maximum.reduceat(high[order], cut)
        one = order[cut]
        gram, content, part = gram[one], content[one], part[one]
        lists = [texts[k].split(b" ") for k in one.tolist()]
        lengths = np.array([len(x) for x in lists], np.int64)
        ids: dict[bytes, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids) + 1) for x in lists for w in x), np.int64, int(lengths.sum()))
        index = FMIndex(flat, lengths)
        counts = lengths - window + 1
        owner = np.repeat(np.arange(len(lists)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = (np.cumsum(lengths + 1) - lengths - 1)[owner] + offset + window
        length, first, last = index.matching_statistics(index.text, ends, window)
        assert (length == window).all(), "an indexed window must be found"
        intervals, which = np.unique(first * (index.n + 1) + last, return_inverse=True)
        bounds = np.stack([intervals // (index.n + 1), intervals % (index.n + 1)], 1)
        by_suffix = np.append(low[index.sequence[index.order]], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(by_suffix, bounds.ravel())[::2][which.ravel()]
        mins = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(least))
        later = pa.array(np.logical_or.reduceat(least < np.repeat(high, counts), np.cumsum(counts) - counts))
        return pa.table({"gram": gram.view(np.int64), "content": content.view(np.int64), "part": part, "mins": mins.cast(pa.list_(pa.int64()))}).filter(later)
    return run


def _marks(ranges: int):
    """First words of repeated windows, from occurrences beside their segments' smallest ids; packed by ranges of row hashes."""
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["place"], rows["key"], rows["id"]))]
        rows = rows[np.append(True, (rows["id"][1:] != rows["id"][:-1]) | (rows["key"][1:] != rows["key"][:-1]) | (rows["place"][1:] != rows["place"][:-1]))]
        part = (_spread(rows["id"].view(np.uint64) ^ mix64(rows["key"].view(np.uint64))) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        rows = rows[order]
        names, cut = np.unique(part[order], return_index=True)
        pieces = [_pack(*(rows[name][a:b].copy() for name in PLACE.names)) for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(pieces, pa.binary())], ["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs, mins = batch.column(0), batch.column(2)
            rows = np.frombuffer(b"".join(x.as_buffer() for x in blobs), PLACE)
            counts = np.array([x.as_buffer().size for x in blobs], np.int64) // PLACE.itemsize
            owner = np.repeat(np.arange(len(counts)), counts)
            first = mins.offsets.to_numpy().astype(np.int64)
            least = mins.values.to_numpy()
            size = np.diff(first)
            for i in range(int(size.max())):
                live = size[owner] > i
                some, of = rows[live], owner[live]
                mark = least[first[of] + i] < some["id"]
                if mark.any():
                    one = some[mark].copy()
                    one["place"] += batch.column(1).to_numpy()[of[mark]] + i
                    parts.append(one)
                    held += len(one)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)
    return run


def _gathered(t: pa.Table) -> pa.Table:
    """All marks of a range: one row per (id, key) with its first words in order."""
    parts = [_unpack(memoryview(x.as_buffer()), "<i8", "<i8", "<i4") for x in t.column("rows")]
    id, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, key, id))
    id, key, place = id[order], key[order], place[order]
    new = np.append(True, (id[1:] != id[:-1]) | (key[1:] != key[:-1]))
    once = new | np.append(True, place[1:] != place[:-1])
    cut = np.flatnonzero(new[once])
    places = pa.ListArray.from_arrays(pa.array(np.append(cut, int(once.sum())).astype(np.int32)), pa.array(place[once]))
    return pa.table({"id": id[once][cut], "key": key[once][cut], "places": places.cast(pa.list_(pa.int32()))})


def repeated_windows(docs: DataFrame, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """First words of the repeated windows of each row: id, key, places (``docs``: id long, key, text)."""
    known = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    shared, hot, total = gram_filters(known.select("id", "text"), window, hot_segments)
    filters = docs.sparkSession.sparkContext.broadcast((shared, hot))
    found = stored(segments(known, window, filters, max(1, -(-total // shard_segments))), "segments")
    mins = stored(found.where("shard IS NOT NULL").select("shard", "blob").groupBy("shard")
                  .applyInArrow(_shard(window), "gram long, content long, part int, mins array<long>"), "windows")
    hits = (found.where("shard IS NULL").select("gram", "content", "places").join(mins.hint("merge"), ["gram", "content"])
            .select("places", "part", "mins").mapInArrow(_marks(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part int, rows binary"))
    return hits.groupBy("part").applyInArrow(_gathered, "id long, key long, places array<int>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def _covered(n: int, places, window: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    if places is not None and len(places):
        places = np.asarray(places)
        np.add.at(change, places, 1)
        np.add.at(change, places + window, -1)
    return np.cumsum(change[:n]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """Per document: id, number of words, of removed words, and the digest of the kept words joined by spaces."""
    base = keyed(docs, id_col, text_col)
    marks = stored(repeated_windows(base, window, **limits), "marks")
    marked = docs.sparkSession.sparkContext.broadcast(mark_filter(marks))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that no mark can meet are finished; the others keep their text."""
        for batch in batches:
            maybe = _set(marked.value, MARK_BITS, batch.column(3).to_numpy().view(np.uint64))
            total, digest = [None] * batch.num_rows, [None] * batch.num_rows
            for k in np.flatnonzero(~maybe).tolist():
                words = (batch.column(1)[k].as_py() or "").encode().split()
                total[k], digest[k] = len(words), hashlib.sha256(b" ".join(words)).hexdigest()
            text = pc.if_else(pa.array(maybe), batch.column(1), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), text, pa.array(total, pa.int64()), pa.array(digest, pa.string())], ["id", "key", "text", "n", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest = [], [], []
            for text, places, n, done in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                lost = 0
                if done is None:
                    words = (text.as_py() or "").encode().split()
                    n = len(words)
                    if places.is_valid:
                        off = _covered(n, places.values.to_numpy(), window)
                        lost = int(off.sum())
                        words = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
                    done = hashlib.sha256(b" ".join(words)).hexdigest()
                total.append(n)
                gone.append(lost)
                digest.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    first = (base.select("id", "text", "key", _row_hash("id", "key").alias("h"))
             .mapInArrow(plain, "id long, key long, text string, n long, digest string"))
    rows = first.join(marks.hint("merge"), ["id", "key"], "left").select("id", "text", "places", "n", "digest")
    return rows.mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def deduplicated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with their repeated words cut from the text (other words stay as they stand, joined
    by one space where something went); documents of which nothing is left go, except those that had no word."""
    marks = stored(repeated_windows(keyed(docs, id_col, text_col), window), "marks")
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            fields = row.flatten()
            texts, keep = [], []
            for text, places in zip(fields[at].to_pylist(), batch.column(1), strict=True):
                if places.is_valid:
                    words = text.encode().split()
                    off = _covered(len(words), places.values.to_numpy(), window).tolist()
                    text = b" ".join(w for w, x in zip(words, off, strict=True) if not x).decode()
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, schema.fieldNames())], ["row"]).filter(pa.array(keep, pa.bool_()))

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    rows = rows.withColumn("maybe", maybe_marked(marks))
    joined = rows.where("maybe").join(marks.hint("merge"), ["id", "key"], "left").select("row", "places").mapInArrow(cut, f"row {schema.simpleString()}")
    return rows.where(~F.col("maybe")).select("row").unionByName(joined).select("row.*")
