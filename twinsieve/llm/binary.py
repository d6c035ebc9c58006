"""Token ids in binary files of fixed-width packed bits, with random access.

File: `TSB1`, then blocks of packed ids (each id in the fewest bits that hold the vocabulary,
little-endian bit order), then the footer: int64 doc ids, uint8 validity of each, uint64 first
id of each document and the end, uint64 byte offset of each block and the end, then seven
uint64 (version, bits, ids a block, ids, documents, footer bytes, checksum of the footer) and
`TSB1`. A reader seeks from the end, so any document or block can be read alone.

One task writes one file, under a name of its own attempt; the manifest names the files of the
tasks that succeeded, so a task that is run again leaves at most an unread file.

Defined cases: null text is empty and yields the end id alone; repeated doc ids are documents
of their own, in the order of their texts' hashes; null doc ids come first; an empty table
gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, scratch_path
from .tokens import encoder_of, in_batches

MAGIC = b"TSB1"
_TAIL = "<7Q4s"
_TAIL_BYTES = struct.calcsize(_TAIL)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackedWriter:
    """Streams ids into a file; holds one block and two numbers a document."""

    def __init__(self, stream, bits: int, block_ids: int):
        self.out, self.bits, self.block_ids = stream, bits, block_ids
        self.docs: list[int | None] = []
        self.starts, self.blocks, self.ids, self.at = [0], [len(MAGIC)], 0, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            full = len(whole) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(whole[i : i + self.block_ids])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.out.write(raw)
        self.at += len(raw)
        self.blocks.append(self.at)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = (
            np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is not None for d in self.docs], "u1").tobytes()
            + np.array(self.starts, "<u8").tobytes() + np.array(self.blocks, "<u8").tobytes()
        )
        self.out.write(footer + struct.pack(_TAIL, 1, self.bits, self.block_ids, self.ids, len(self.docs), len(footer), zlib.crc32(footer), MAGIC))


class PackedReader:
    """Random access by document; reads the blocks that a range of ids touches."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - _TAIL_BYTES)
        _, self.bits, self.block_ids, self.ids, n, length, check, magic = struct.unpack(_TAIL, file.read(_TAIL_BYTES))
        file.seek(size - _TAIL_BYTES - length)
        footer = file.read(length)
        if magic != MAGIC or zlib.crc32(footer) != check:
            raise ValueError("not a packed token file, or a damaged one")
        valid = np.frombuffer(footer, "u1", n, 8 * n)
        self.docs = [int(d) if v else None for d, v in zip(np.frombuffer(footer, "<i8", n), valid, strict=True)]
        self.starts = np.frombuffer(footer, "<u8", n + 1, 9 * n).astype(np.int64)
        self.blocks = np.frombuffer(footer, "<u8", -1, 9 * n + 8 * (n + 1)).astype(np.int64)

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1 of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(int(self.blocks[a]))
        raw = self.file.read(int(self.blocks[b + 1] - self.blocks[a]))
        out, first = [], a * self.block_ids
        for k in range(a, b + 1):
            n = min(self.block_ids, self.ids - k * self.block_ids)
            out.append(unpack_bits(raw[self.blocks[k] - self.blocks[a] : self.blocks[k + 1] - self.blocks[a]], self.bits, n))
        return np.concatenate(out)[start - first : end - first]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of all, reading about so many ids at a time."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids, "right")) - 1)
            part = self.span(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield self.docs[k], int(self.starts[k]), part[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j


def write_packed(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2, keeps_space: bool = False, block_ids: int = 4096) -> DataFrame:
    """Encode docs(doc_id, text) in ascending doc_id order into files of folder.

    Returns the manifest (part, file, n_docs, n_ids, base): the files in order, base being the
    ids in all files before. The text is shuffled once, by ranges of doc_id.
    """
    spark = docs.sparkSession

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = writer = None
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            if texts and writer is None:
                encoder = encoder_of(tokenizer, keeps_space)
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"{top}/part-{part:06d}-{uuid.uuid4().hex}.tokens"
                stream = store.open_output_stream(name)
                writer = PackedWriter(stream, bits_for(max(encoder.vocabulary, end_id + 1)), block_ids)
            for a, b in in_batches(texts):
                for doc_id, raw in zip(ids[a:b], encoder.encode_many([t or "" for t in texts[a:b]]), strict=True):
                    writer.add(doc_id, np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
        if writer:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    files = placed.select("doc_id", "text").mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    manifest = Scratch(spark).cut(files, "packed-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_packed(manifest: DataFrame) -> DataFrame:
    """The documents of all files: doc_id, start (ids before it in all files), n_tokens, ids (uint32)."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for doc_id, start, ids in PackedReader(file).documents():
                        rows.append((doc_id, row["base"] + start, len(ids), ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held >= 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = manifest.select("part", "file", "base")
    tasks = spread.agg(F.max("part")).first()[0]  # the manifest has a row a file
    spread = spread.repartitionById((tasks or 0) + 1, F.col("part").cast("int")).select("file", "base")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def default_folder(docs: DataFrame) -> str:
    path = scratch_path(docs.sparkSession, "packed")
    return path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)
