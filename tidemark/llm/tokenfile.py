"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id (then by a hash of the text, so that a repeated id
cannot overload a task) and sorted; each task writes one shard:

* ``shard-NNNNN.bin``: ids, unsigned, 16 bits if the vocabulary allows, else 32, little-endian;
* ``shard-NNNNN.idx``: number of documents n, then n + 1 token offsets, as 64-bit integers.

The document ids stand beside them in a small Parquet table.  Files are written under a
name of the attempt and then moved, so a repeated or lost task leaves whole files only.
The base of each shard is a prefix sum over one row per shard.  Reading maps the files.

Nulls are empty texts (the end id alone); a null id sorts first; repeated ids keep their
order by text hash; an empty table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import shared_folder, slices, span_hashes, utf8_parts
from tidemark.llm.bpe import default_vocabulary

#: Table size of an encoder: 16 bytes each, plus four bytes for every id kept.
SLOTS = 1 << 22
END_ID = 2


class LibraryEncoder:
    """The tokenizers library behind a bounded table of pieces.

    A text is cut before each space or line end that stands between two words, where the
    byte-level pre-tokenizer always cuts.  Pieces are found by a 64-bit hash in an
    open-addressing table (numpy arrays, emptied when full), and the library encodes those
    not met lately; texts with other white space, with runs of it or with an added token go
    to the library whole.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        (self.newline,) = self.library.encode("\n", add_special_tokens=False).ids
        self.slots = slots
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.place, self.length = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.store, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not in the table."""
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        found = np.where(self.keys[slot] == h, slot, -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[slot] != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (self.slots - 1)
            key = self.keys[slot]
            hit = key == h[open_]
            found[open_[hit]] = slot[hit]
            more = ~hit & (key != 0)
            open_, slot = open_[more], slot[more]
        return found

    def _insert(self, h: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Add distinct hashes that are not in the table; ``ids`` of all end to end."""
        if self.used + len(ids) > len(self.store):
            grown = np.zeros(2 * (self.used + len(ids)), np.uint32)
            grown[:self.used] = self.store[:self.used]
            self.store = grown
        self.store[self.used:self.used + len(ids)] = ids
        place = self.used + np.cumsum(length) - length
        self.used += len(ids)
        self.held += len(h)
        slot, todo = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1), np.arange(len(h))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = h[todo[free]]              # of two for one slot the later stays, the other moves on
            mine = self.keys[slot[todo]] == h[todo]
            done = todo[mine]
            self.place[slot[done]], self.length[slot[done]] = place[done], length[done]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Encode pieces in one text, a piece a line: a line end between words is always a token of its own."""
        pieces = [raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        led = np.array([p[:1] == b"\n" for p in pieces])
        text = b"".join(p if own else b"\n" + p for p, own in zip(pieces, led.tolist(), strict=True)) + b"\n"
        ids = self._ask([text.decode()])[0]
        ends = np.flatnonzero(ids == self.newline)
        length = np.diff(ends) - 1 + led
        keep = np.ones(len(ids), bool)
        keep[ends[:-1][~led]] = False
        keep[ends[-1]] = False
        self._insert(h, ids[keep], length)

    def _odd(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows whose white space or added tokens forbid cutting."""
        blank = (raw == 0x20) | (raw == 0x0A)
        after = np.append(raw[1:], 0)
        third = np.append(raw[2:], [0, 0])[:len(raw)]
        bad = (raw < 0x20) & (raw != 0x0A) | (raw == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (raw == 0xE1) & (after == 0x9A) | (raw == 0xE3) & (after == 0x80) & (third == 0x80)
        wide = (raw == 0xE2) & ((after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (after == 0x81) & (third == 0x9F))
        closing = np.zeros(len(raw) + 1, bool)
        closing[at[1:][at[1:] > at[:-1]] - 1] = True                 # last byte of each text
        bad |= wide | blank & (np.append(blank[1:], False) | closing[:-1])
        odd = np.zeros(len(at) - 1, bool)
        odd[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
        whole = raw.tobytes()
        for token in self.added:
            k = whole.find(token)
            while k >= 0:
                odd[np.searchsorted(at, k, "right") - 1] = True
                k = whole.find(token, k + 1)
        return odd

    def encode_rows(self, raw: np.ndarray, at: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end (``at`` begins with 0), each followed by ``end_id``; number of ids of each."""
        n = len(at) - 1
        odd = self._odd(raw, at) if len(raw) else np.zeros(n, bool)
        cut = (raw == 0x20) | (raw == 0x0A)
        cut[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw)) if len(start) else start
        row = np.searchsorted(at, start, "right") - 1
        if odd.any():
            usual = ~odd[row]
            start, end, row = start[usual], end[usual], row[usual]
        h = np.maximum(span_hashes(raw, start, end), np.uint64(1))
        if self.held > self.slots * 5 // 8:
            self._clear()
        slot = self._find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            if self.held + len(fresh) > self.slots * 3 // 4:
                self._clear()
                fresh, first = np.unique(h, return_index=True)
                missing = np.arange(len(h))
                if len(fresh) > self.slots * 3 // 4:
                    self.slots *= 4
                    self._clear()
            self._learn(raw.tobytes(), start[missing[first]], end[missing[first]], fresh)
            slot[missing] = self._find(h[missing])
        length = self.length[slot].astype(np.int64)
        counts = np.bincount(row, length, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        extra = 0 if end_id is None else 1
        if odd.any():
            texts = self._ask([raw[at[k]:at[k + 1]].tobytes().decode() for k in np.flatnonzero(odd)])
            counts[odd] = [len(t) for t in texts]
        out = np.empty(int(counts.sum()) + extra * n, np.uint32)
        begin = np.cumsum(counts + extra) - (counts + extra)
        total = int(length.sum())
        source = np.repeat(self.place[slot] - (np.cumsum(length) - length), length) + np.arange(total)
        if odd.any() or extra:
            ahead = np.cumsum(counts * ~odd) - counts * ~odd         # ids of the cut rows before each row
            target = np.arange(total) + np.repeat(begin[row] - ahead[row], length)
            out[target] = self.store[source]
        else:
            out[:] = self.store[source]
        if odd.any():
            for k, ids in zip(np.flatnonzero(odd).tolist(), texts, strict=True):
                out[begin[k]:begin[k] + len(ids)] = ids
        if extra:
            out[begin + counts] = end_id
        return out, counts + extra

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        data = [t.encode() for t in texts]
        ids, counts = self.encode_rows(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                      end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the shards below ``folder`` (a URI all machines reach); returns one row per document:
    shard, place, id.  The rows are in Parquet beside the shards, so nothing is encoded twice."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        lib = encoder(vocabulary or default_vocabulary())
        kind_of = np.dtype("<u2" if max(lib.size - 1, end_id) < 1 << 16 else "<u4")
        attempt = f"{base}/.{shard:05d}-{uuid.uuid4().hex}"
        sizes, done = [np.zeros(0, np.int64)], 0
        with store.open_output_stream(f"{attempt}.bin") as sink:
            for batch in batches:
                data, at = utf8_parts(batch.column(1))
                for first, last in slices(at):
                    ids, counts = lib.encode_rows(data[at[first]:at[last]], at[first:last + 1] - at[first], end_id)
                    sizes.append(counts)
                    sink.write(ids.astype(kind_of).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(done, done + n, dtype=np.int64)), batch.column(0)], ["shard", "place", "id"])
                done += n
        with store.open_output_stream(f"{attempt}.idx") as sink:
            offsets = np.zeros(done + 2, "<i8")
            offsets[0] = done
            np.cumsum(np.concatenate(sizes), out=offsets[2:])
            sink.write(offsets.tobytes())
        for end_of in ("bin", "idx"):
            store.move(f"{attempt}.{end_of}", f"{base}/shard-{shard:05d}.{end_of}")

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    n = [shards] if shards else []
    dealt = frame.repartitionByRange(*n, *order).sortWithinPartitions(*order, "text")
    rows = dealt.mapInArrow(run, f"shard int, place long, id {kind}")
    rows.write.mode("overwrite").parquet(f"{folder}/documents")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/documents")


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped where the folder is mounted, else read from the store."""
    if store.type_name == "local":
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_token_files(spark: SparkSession, folder: str, rows: DataFrame, id_col: str = "doc_id", wide: bool = False) -> DataFrame:
    """Per document: id, start among all ids, number of ids, crc32 of its ids as unsigned 32-bit integers."""
    kind = rows.schema["id"].dataType.simpleString()
    code = "<u4" if wide else "<u2"

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            shards = batch.column(0).to_pylist()
            size = [int(_mapped(store, f"{base}/shard-{s:05d}.idx", "<i8")[-1]) for s in shards]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64())], ["shard", "size"])

    found = rows.select("shard").distinct().mapInArrow(totals, "shard int, size long").collect()       # one row per shard
    base_of, so_far = {}, 0
    for shard, size in sorted(found):
        base_of[shard] = so_far
        so_far += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        open_files: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            shard, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            start, size, crc = [], [], []
            for s, p in zip(shard.tolist(), place.tolist(), strict=True):
                if s not in open_files:
                    open_files.clear()
                    open_files[s] = (_mapped(store, f"{base}/shard-{s:05d}.idx", "<i8")[1:], _mapped(store, f"{base}/shard-{s:05d}.bin", code))
                offsets, ids = open_files[s]
                a, b = int(offsets[p]), int(offsets[p + 1])
                start.append(base_of[s] + a)
                size.append(b - a)
                crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["id", "start", "n_tokens", "ids_crc32"])

    return rows.select("shard", "place", "id").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back from the mapped files."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    rows = write_token_files(docs, folder, id_col, text_col, vocabulary)
    size = encoder(vocabulary or default_vocabulary()).size
    return read_token_files(spark, folder, rows, id_col, wide=max(size - 1, END_ID) >= 1 << 16)
