"""Packing documents along a space-filling curve.

Each document becomes a hashed vector (byte trigrams, counted into DIMS * 64 slots), is
projected to three dimensions by fixed random signs, and gets the Hilbert key of its cell.
A range partition and a sort by that key bring like documents together; each partition then
concatenates its documents in curve order and cuts the stream every `length` ids. The rest of
a partition is cut into powers of two, so no sequence needs padding.

Defined cases: null and empty texts yield the end id alone and the middle cell; repeated rows
and ties are ordered by doc_id and the text's hash, which are also range-partitioned, so a
large group of copies spreads over tasks; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder_of, in_batches

SLOTS, BITS, AXES = 256, 10, 3


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, axes), bits an axis (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_cells(texts: list[bytes]) -> np.ndarray:
    """Integer points (n, AXES) of texts' hashed vectors."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.zeros((len(texts), SLOTS), np.float32)
    if len(data) > 2:
        h = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(24)
        at = np.repeat(np.arange(len(texts)) * SLOTS, lengths)[:-2]
        at += h
        ends = np.cumsum(lengths)
        over = np.concatenate([ends - 2, ends - 1])
        at[over[(over >= 0) & (over < len(at))]] = len(texts) * SLOTS  # trigrams over two texts
        counts = np.bincount(at, minlength=len(texts) * SLOTS + 1)[:-1].reshape(-1, SLOTS).astype(np.float32)
    v = np.sqrt(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    signs = np.random.default_rng(10).choice(np.array([-1, 1], np.float32), (SLOTS, AXES))
    return np.clip((1 / (1 + np.exp(-4 * (v @ signs)))) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def curve_keys(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the Hilbert key of each document."""

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in in_batches(texts):
                out = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(hilbert_key(document_cells(texts[a:b])))], names=[*out.schema.names, "curve"])

    return docs.select("doc_id", "text").mapInArrow(keys, "doc_id long, text string, curve long")


class _Packer:
    """Cuts a stream of documents into sequences; holds the pieces of the open one."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.open: list[tuple] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while at < total:
            n = min(total - at, self.length - self.filled)
            self.open.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            self.filled += n
            if self.filled == self.length:
                self._emit(self.open)
                self.open, self.filled = [], 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def close(self) -> None:
        """The rest, as sequences of powers of two, the longest first."""
        rest = self.open
        while self.filled:
            room = 1 << (self.filled.bit_length() - 1)
            self.filled -= room
            took = []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // 4)
                took.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (doc_id, start + n, ids[4 * n :], total))
                room -= n
            self._emit(took)
        self.open = []


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 0, length: int = 1024, keeps_space: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids (uint32), doc_tokens, sequence_id, offset."""
    end = int(end_id).to_bytes(4, "little")

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
        packer, encoder = _Packer(length, TaskContext.get().partitionId() << 40), None

        def rows():
            out, packer.rows = packer.rows, []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            encoder = encoder or encoder_of(tokenizer, keeps_space)
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in in_batches(texts):
                for doc_id, raw in zip(ids[a:b], encoder.encode_many([t or "" for t in texts[a:b]]), strict=True):
                    packer.add(doc_id, raw + end)
                yield from rows()
        packer.close()
        yield from rows()

    order = ["curve", "doc_id", "_tie"]
    placed = curve_keys(docs).withColumn("_tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("doc_id", "text").mapInArrow(
        pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
