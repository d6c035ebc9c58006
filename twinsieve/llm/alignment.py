"""Alignment of two tokenizers' ids over the same bytes, and corpus-wide counts of linked pairs.

A: byte-level BPE of space + text. B: sentencepiece BPE of the text, which adds that space. Both cut
the same bytes. The starts of B's tokens are a static index of intervals; two bisections per A token
give the list of B tokens it overlaps (its links). An A token spans the gaps between the B tokens
of its list; gaps that no A token spans are the boundaries of groups.

Neither tokenizer joins anything across the gap in front of a run of white space that starts with a
plain space or newline, nor between a letter and the full stops and commas that end a word, so texts
are cut there and each distinct chunk is encoded and aligned once a task. Texts with rare
separators, for which that is not certain, go whole.

Counts: a task writes blocks of documents (about BLOCK_CHARS characters, or one longer document)
with a dictionary of their chunks and of the id pairs these link. Pair counts are summed by pair
over all blocks; each block then gets the counts of its own distinct pairs back and adds them up
per document. What is shuffled is one row per pair and block, however often a pair occurs.

Defined cases: null and empty texts, and texts whose joined tokens differ from space + text, have
no tokens and link nothing; null and repeated ids are documents of their own; equal texts give
equal rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .tokens import ChunkEncoder, in_batches

BLOCK_CHARS, CACHE_CHUNKS, CACHE_CHARS = 2_000_000, 400_000, 30_000_000
#: White space other than the plain space and newline on which both tokenizers agree.
_WHITE = r"\t\x0b\x0c\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A run of white space that starts with a space or newline and a plain word; the stops behind one; else all up to the next such run.
_CHUNK = re.compile(
    rf"[ \n]+[{_LETTER}]+(?=[.,]*(?:[ \n]|\Z))|(?<=[{_LETTER}])[.,]+(?=[ \n]|\Z)"
    rf"|[ \n][ \n{_WHITE}]*[^ \n]*(?:(?<=[{_WHITE}])[ \n][ \n{_WHITE}]*[^ \n]*)*"
).findall
_UNSURE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]").search

_BLOCK = (
    "block string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
    "doc_ends binary, words binary, chunk_ends binary, chunk_pairs binary, pairs array<long>, pair_n array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, last: A token i overlaps the B tokens first[i] .. last[i] - 1; spanned: whether an A token covers the gap before B token j."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left")
    opened = np.zeros(len(b_ends) + 1, np.int64)
    np.add.at(opened, first + 1, 1)
    np.add.at(opened, last, -1)
    return first, last, np.cumsum(opened)[:-1] > 0


class ChunkAligner:
    """Distinct chunks by number, each encoded and aligned once."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import pre_tokenizers

        self.a = ChunkEncoder(a_path, keeps_space=True)
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in self._letters(pre_tokenizers)}
        size = self.a.tokenizer.get_vocab_size()
        self.a_bytes = [bytes(byte_of[c] for c in p) if (p := self.a.tokenizer.id_to_token(i)) and all(c in byte_of for c in p) else (p or "").encode() for i in range(size)]
        hexed = re.compile("<0x([0-9A-F]{2})>").fullmatch
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := hexed(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.space = self.b.piece_to_id("▁")
        self.spelt = [b"%d%c" % (i, c) for i in range(max(size, len(pieces))) for c in b",|;"]  # an id before another, before B's, before the next group
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.clear()

    @staticmethod
    def _letters(pre_tokenizers):
        """The characters that stand for bytes: printable ones for themselves, the others from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        return [*((b, chr(b)) for b in own), *((b, chr(256 + i)) for i, b in enumerate(other))]

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.chars = 0
        self.groups: list[bytes] = []  # of each chunk, every id followed by its separator
        self.strange: set[int] = set()  # chunks whose bytes differ
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each chunk
        self.codes = np.zeros(0, np.int64)  # their links in order, B's id above A's

    def _b_ids(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks in their places: it puts a space in front, which a chunk that starts with one has already.

        A newline joins nothing, so what does not start with white space is encoded behind one.
        """
        plain = self.b.encode([c[1:] if c[0] == " " else c if c[0] == "\n" else f"\n{c}" for c in chunks], num_threads=1)
        return [([self.space] if c == " " else ids) if c[0] == " " else ids[1:] if c[0] == "\n" else ids[2:] for c, ids in zip(chunks, plain, strict=True)]

    def learn(self, chunks: list[str]) -> range:
        """Numbers of new chunks, which are aligned together on one axis of bytes."""
        first = len(self.groups)
        a_raw, b_lists, raw = self.a.encode_many(chunks), self._b_ids(chunks), [c.encode() for c in chunks]
        a_n, b_n = np.fromiter(map(len, a_raw), np.int64, len(chunks)) // 4, np.fromiter(map(len, b_lists), np.int64, len(chunks))
        a = np.frombuffer(b"".join(a_raw), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_lists), np.int64, b_n.sum())
        a_bytes, b_bytes = (b"".join(map(t.__getitem__, ids.tolist())) for t, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_last, b_last = np.cumsum(a_n), np.cumsum(b_n)
        whole = b"".join(raw)
        if a_bytes != whole or b_bytes != whole or not (a_n.all() and b_n.all()) or (a_ends[a_last - 1] != ends).any() or (b_ends[b_last - 1] != ends).any():
            return self._learn_strange(chunks, raw, a_raw, b_lists)
        low, high, spanned = overlaps(a_ends, b_ends)
        n = high - low
        link_ends = np.cumsum(n)
        at = np.repeat(low - link_ends + n, n) + np.arange(n.sum())
        codes = (b[at] << 32) | np.repeat(a, n)
        b_group = np.cumsum(~spanned) - 1
        a_group = b_group[low]  # a group starts at one byte on both sides
        # ids in the order of the text of groups: A's of a group, then B's
        keys = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(keys, kind="stable")
        last = np.concatenate([keys[order][1:] != keys[order][:-1], [True]])
        marks = np.where(last, 1 + (keys[order] & 1), 0)
        words = list(map(self.spelt.__getitem__, (3 * np.concatenate([a, b])[order] + marks).tolist()))
        cuts = np.concatenate([[0], np.cumsum(a_n + b_n)]).tolist()
        self.groups += [b"".join(words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        per = lambda ends_of_chunks: np.diff(ends_of_chunks, prepend=0)
        self.counts = np.concatenate([self.counts, np.stack([a_n, b_n, per(b_group[b_last - 1] + 1), per(link_ends[a_last - 1])], axis=1)])
        self.codes = np.concatenate([self.codes, codes])
        return range(first, len(self.groups))

    def _learn_strange(self, chunks: list[str], raw: list[bytes], a_raw: list[bytes], b_lists: list[list[int]]) -> range:
        """Like learn, where the bytes of some chunks differ: those get a number without tokens."""
        first = len(self.groups)
        joined = lambda table, ids: b"".join(map(table.__getitem__, ids))
        good = [joined(self.a_bytes, np.frombuffer(x, "<u4").tolist()) == r == joined(self.b_bytes, y) for r, x, y in zip(raw, a_raw, b_lists, strict=True)]
        known = iter(self.learn([c for c, g in zip(chunks, good, strict=True) if g])) if any(good) else iter(())
        bad = good.count(False)
        self.strange.update(range(len(self.groups), len(self.groups) + bad))
        other = iter(range(len(self.groups), len(self.groups) + bad))
        self.groups += [b""] * bad
        self.counts = np.concatenate([self.counts, np.zeros((bad, 4), np.int64)])
        self.numbers.update({c: next(known) if g else next(other) for c, g in zip(chunks, good, strict=True)})
        return range(first, first)

    def documents(self, texts: list[str | None]) -> list[list[int]]:
        """The chunk numbers of each text; none where it has no tokens."""
        plans = [None if not t else [f" {t}"] if _UNSURE(t) else _CHUNK(f" {t}") for t in texts]
        numbers = self.numbers
        new = list(set().union(*(p for p in plans if p)).difference(numbers))
        for part in range(0, len(new), 20_000):
            chunks = new[part : part + 20_000]
            self.chars += sum(map(len, chunks))
            numbers.update(zip(chunks, self.learn(chunks), strict=False))  # none left where some were strange
        found = [list(map(numbers.__getitem__, p)) if p else [] for p in plans]
        return [f if self.strange.isdisjoint(f) else [] for f in found] if self.strange else found


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0 in 2 bytes each where they fit, else 4; the first byte tells."""
    kind = "<u2" if not len(values) or values.max() < 1 << 16 else "<u4"
    return kind[2].encode() + values.astype(kind).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1)


class _Block:
    def __init__(self):
        self.ids, self.docs, self.chars = [], [], 0

    def row(self, aligner: ChunkAligner, name: str, hashed: bool) -> dict:
        ends = np.cumsum([len(d) for d in self.docs], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(self.docs), np.int64, ends[-1])
        used, words = np.unique(flat, return_inverse=True)
        counts, link_ends = aligner.counts[used], np.cumsum(aligner.counts[:, 3])[used]
        links, chunk_ends = counts[:, 3], np.cumsum(counts[:, 3])
        codes = aligner.codes[np.repeat(link_ends - chunk_ends, links) + np.arange(links.sum())]
        pairs, chunk_pairs = np.unique(codes, return_inverse=True)
        n = np.bincount(chunk_pairs, weights=np.repeat(np.bincount(words, minlength=len(used)), links), minlength=len(pairs)).astype(np.int64)
        of_doc = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[words], axis=0)])[np.concatenate([[0], ends])], axis=0)
        texts = [b"".join(map(aligner.groups.__getitem__, d))[:-1] for d in self.docs]
        groups = [hashlib.sha256(t).hexdigest() if hashed and t else t.decode() for t in texts]
        return {
            "block": name, "doc_ids": self.ids, "n_a": of_doc[:, 0], "n_b": of_doc[:, 1], "n_groups": of_doc[:, 2], "n_links": of_doc[:, 3], "groups": groups,
            "doc_ends": ends.tobytes(), "words": _small(words), "chunk_ends": _small(chunk_ends), "chunk_pairs": _small(chunk_pairs), "pairs": pairs, "pair_n": n,
        }


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, hashed: bool) -> DataFrame:
    def align(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, block, made, part = None, _Block(), 0, TaskContext.get().partitionId()

        def emit():
            nonlocal block, made
            name, made = f"{part}-{made}", made + 1
            out = pa.RecordBatch.from_pydict({k: [v] for k, v in block.row(aligner, name, hashed).items()})
            block = _Block()
            if len(aligner.groups) > CACHE_CHUNKS or aligner.chars > CACHE_CHARS:
                aligner.clear()
            return out

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in in_batches(texts, BLOCK_CHARS // 2):
                aligner = aligner or ChunkAligner(a_path, b_path)
                block.docs += aligner.documents(texts[a:b])
                block.ids += ids[a:b]
                block.chars += sum(len(t or "") for t in texts[a:b])
                if block.chars >= BLOCK_CHARS:
                    yield emit()
        if block.ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(align, _BLOCK)


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, hashed: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of docs(doc_id, text).

    groups: the ids of A and B of each group in order, as `a1,a2|b1;a3|b2,b3`, or its SHA-256. A link's
    count is how many links of all documents hold its id pair; n_best counts the links
    whose count is the highest that their B id has anywhere.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.cut(aligned_blocks(docs, a_path, b_path, hashed), "aligned")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_n").alias("n"))
    counts = scratch.cut(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.shiftright("pair", 32)
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row per id of B's vocabulary at most
    told = counts.join(F.broadcast(best), b_id == F.col("b")).select(F.col("pair").alias("of"), F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("is_best"))
    asked = pairs.select("block", "at", "pair").join(told, F.col("pair") == F.col("of"))
    back = asked.groupBy(F.col("block").alias("for")).agg(F.collect_list(F.struct("at", "total", "is_best")).alias("told"))  # the pairs of one block

    def finish(batches):
        import pyarrow as pa

        kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])
        for batch in batches:
            for i in range(len(batch)):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                n_pairs = len(r["pairs"].values)
                total, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
                if r["told"].is_valid:
                    t = r["told"].values
                    at = t.field("at").to_numpy()
                    total[at], best[at] = t.field("total").to_numpy(), t.field("is_best").to_numpy(zero_copy_only=False)
                between = lambda values, ends: np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)
                chunk_pairs, chunk_ends, words = (_numbers(r[c].as_py()) for c in ("chunk_pairs", "chunk_ends", "words"))
                doc_ends = np.frombuffer(r["doc_ends"].as_py(), np.int64)
                sums = [between(between(values[chunk_pairs], chunk_ends)[words], doc_ends) for values in (best, total)]
                yield pa.RecordBatch.from_arrays([*[r[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")], *map(pa.array, sums), r["groups"].values], schema=kind)

    return blocks.join(back, F.col("block") == F.col("for"), "left").drop("for", "pair_n").mapInArrow(finish, _RESULT)
