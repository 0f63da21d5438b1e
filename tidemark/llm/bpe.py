"""Byte-level BPE: encoding by a queue of merge ranks, decoding from vocabulary strings.

Each pre-token is a doubly linked list of symbols.  A heap holds the mergeable pairs by
rank, then place; an entry whose symbols have changed since is skipped.  Texts are cut at
single spaces first, which never lie inside a pre-token, so that what a worker has merged
once is looked up from then on (bounded caches, cleared when full).

Nulls are empty texts and give no ids; repeated rows give repeated results; columns other
than the id and the text are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 200_000
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Vocabulary, merges and caches of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for s, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in s)
        for s, i in self.added.items():
            self.strings[i] = s.encode()
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def push(i: int) -> None:
            j = right[i]
            if i >= 0 and j < n and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:                 # stale: a symbol has been merged meanwhile
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = np.array(self.merge(word.encode()), "<u4").tobytes()
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, self.pattern.findall(text)))

    def _segment(self, text: str) -> bytes:
        """Ids of a text without added tokens, cut before each space (or line end) between two words.

        No pre-token reaches across such a place; a text with longer runs of white space goes
        through the pattern as a whole.
        """
        head, *rest = text.replace("\n", " \n").split(" ")
        out = list(map(self.pieces.get, rest))
        if None in out:
            for k, got in enumerate(out):
                if got is None:
                    piece = rest[k]
                    body = piece[1:] if piece[:1] == "\n" else piece
                    if not body or body[0].isspace():
                        return self._plain(text)
                    got = self.pieces.get(piece)
                    if got is None:
                        got = self._plain(piece if piece[0] == "\n" else " " + piece)
                        if len(self.pieces) >= CACHE:
                            self.pieces.clear()
                        self.pieces[piece] = got
                    out[k] = got
        return self._plain(head) + b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in text for s in self.added):
            return self._segment(text)
        parts = self.specials.split(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if k % 2 else self._segment(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the concatenated vocabulary strings; broken sequences become U+FFFD."""
        data = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode(errors="replace").encode()
        return data


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and file, kept between tasks."""
    return Codec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ids (little-endian unsigned 32-bit, binary) and the decoded text of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary or default_vocabulary())
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                texts = [bpe.decode(x).decode() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Number of ids and digests of ids and of the decoded text, without moving either out of the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary or default_vocabulary())
        for batch in batches:
            count, left, right = [], [], []
            for first in range(0, batch.num_rows, 500):
                for text in batch.column(1).slice(first, 500).to_pylist():
                    ids = bpe.encode(text or "")
                    count.append(len(ids) // 4)
                    left.append(hashlib.sha256(ids).hexdigest())
                    right.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
