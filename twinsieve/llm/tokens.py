"""Exact tokenization by chunks, shared by the binary writer and the packer.

Both vocabularies split a text by a pattern before merging, and no piece of that pattern
crosses the gap in front of a run of visible characters. A text is therefore cut at plain
spaces and newlines, each distinct run is cut into chunks and each distinct chunk encoded by the library
once, and the ids are joined. Texts with any other white space, control character or special-token string go
through the library whole. An encoder serves all tasks of its Python process, so that what one
has learned the next need not.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Anything for which cutting at spaces and newlines could differ from the library's own cut.
_ODD = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u0300-\u036f\u1680\u180e\u2000-\u200f\u2028-\u206f\u3000\ufeff]|<\|")
_LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
#: A plain word apart from the full stops and commas behind it, else all visible characters up to a gap.
_VISIBLE = rf"{_LETTERS}(?=[.,]*(?:[ \n]|\Z))|(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])[.,]+(?=[ \n]|\Z)"
_PLAIN = re.compile(rf" ?{_LETTERS}").fullmatch
_CHUNK = re.compile(rf" ?{_VISIBLE}| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
_WORD = re.compile(rf"{_VISIBLE}|[^ \n]+")
#: Runs of visible characters with the space in front, and what lies between them.
_RUN = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
#: Lower-casing is letter by letter up to here, so it may come before the cut.
_WIDE = re.compile("[^\x00-\xff]")
#: Entries of the cache, cleared when full: memory stays bounded on any vocabulary.
CACHE_ENTRIES = 500_000


def _plain_text(t: str) -> bool:
    """Whether nothing in t is odd; visible ASCII, the most common case, needs no pattern."""
    return "<|" not in t and t.replace("\n", "").isprintable() if t.isascii() else not _ODD.search(t)


class ChunkEncoder(dict):
    """run or chunk -> ids as bytes (little-endian unsigned, `width` bytes each).

    A run is cut into chunks when it is first met. A chunk of plain letters is one piece of the pattern, so the
    library's model merges it alone; others are encoded as texts.
    """

    def __init__(self, path: str, *, keeps_space: bool, width: int = 4, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        self.kind, self.width = f"<u{width}", width
        self.chunks = (_CHUNK if keeps_space else _WORD).findall
        self.runs = _RUN.findall if keeps_space else str.split
        self.lowers = not keeps_space
        self.vocabulary = self.tokenizer.get_vocab_size()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(32, 256)}
        self.model, self.of = self.tokenizer.model, [i.to_bytes(width, "little") for i in range(self.vocabulary)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def __missing__(self, run: str) -> bytes:
        chunks = self.chunks(run)
        if len(chunks) > 1:
            ids = b"".join(map(self.__getitem__, chunks))
        elif _PLAIN(run):
            ids = b"".join([self.of[t.id] for t in self.model.tokenize((run.lower() if self.lowers else run).translate(self.letters))])
        else:
            ids = self.whole(run)
        self[run] = ids
        return ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if self.lowers:
            texts = [t.lower() if t.isascii() or not _WIDE.search(t) else t for t in texts]
        if len(self) > self.entries:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, self.runs(t))) if _plain_text(t) else self.whole(t) for t in texts]


@lru_cache(maxsize=2)
def encoder_of(path: str, keeps_space: bool) -> ChunkEncoder:
    """The process's encoder of a vocabulary."""
    return ChunkEncoder(path, keeps_space=keeps_space)


def in_batches(texts: list[str | None], chars: int = 1_000_000):
    """Slices of row numbers whose texts hold about so many characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
