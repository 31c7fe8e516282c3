"""Texts cut where the tokenizer's pattern always cuts, and a bounded table of coded chunks.

The pattern's matches hold white space only at their front or alone. So there
is a cut before a space, and on both sides of a line feed, that stands alone
between two characters that are no white space. The chunks between such cuts (a
word with its punctuation and the space before it) are numbered per block of
texts by Arrow, each different one is coded once, and numpy puts the ids of all
occurrences in place. A text with other white space is cut by the pattern.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a Python worker remembers, in each of two halves.
REMEMBERED = 250_000
#: Longer chunks are coded anew in each block.
LONGEST = 64
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 4 << 20
#: What may follow a word as a match of its own.
MARKS = frozenset(",.;:!?")
#: Stands before a text's first chunk; a text that holds it is cut by the pattern.
HEAD = "\0"


def _solid(word: str) -> bool:
    """Whether neither end of the word is white space in any reading of the term."""
    return bool(word) and not (word[0].isspace() or word[-1].isspace()) and word[0].isprintable() and word[-1].isprintable()


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def byte_blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[pa.Array]:
    """Runs of consecutive texts of about ``size`` bytes; a longer text is a run of its own."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word, its text's row, the distinct words): words as ``WORD`` in ``rows`` has them."""
    t = texts.cast(pa.large_binary())
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset:t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[ends[0]:ends[-1]].copy() if t.buffers()[2] is not None else np.zeros(0, np.uint8)
    data[(data >= 9) & (data <= 13)] = 32
    plain = pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(data)])
    lists = pc.split_pattern(plain, b" ")
    found = lists.flatten().dictionary_encode()
    number, words = found.indices.to_numpy(), found.dictionary.to_pylist()
    row = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
    if b"" in words:
        full = number != words.index(b"")
        number, row = number[full], row[full]
    return number, row, words


class ChunkCoder:
    """Codes texts through ``code``, which maps one match of the pattern to the bytes of its ids.

    Chunks and the pattern's matches share one table, which has two halves. When
    the newer one is full it becomes the older one; what is met again moves to
    the newer one. So the table stays bounded and keeps what is frequent.
    """

    def __init__(self, code: Callable[[str], bytes], pattern: str, remembered: int = REMEMBERED, block: int = BLOCK, every_text: bool = False):
        import regex

        self.code, self.cut, self.remembered, self.block = code, regex.compile(pattern).findall, remembered, block
        self.every_text = every_text  # for a pattern without these cuts
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of blocks of consecutive texts: ends[i] is where the ids of a block's text i end."""
        for some in byte_blocks(texts, self.block):
            yield self._block(some)

    def __call__(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out = []
        for ids, ends in self.blocks(pa.array(batch, pa.string())):
            out += [x.tobytes() for x in np.split(ids, ends[:-1])]
        return out

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.new) >= self.remembered:
            self.old, self.new = self.new, {}
        if self.every_text:
            parts = [self._by_pattern(t) for t in texts.to_pylist()]
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        marked = pc.binary_join_element_wise(pa.scalar(HEAD), pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked.cast(pa.large_string()), " ")
        found = lists.flatten().dictionary_encode()
        number, words = found.indices.to_numpy(), found.dictionary.to_pylist()
        coded, alone = list(map(self.new.get, words)), np.zeros(len(words), bool)
        for i, ids in enumerate(coded):
            if ids is None:
                coded[i] = ids = self._chunk(words[i])
                if ids is None:
                    coded[i], alone[i] = b"", True  # can't be coded without its neighbours
        joined = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.array(list(map(len, coded)), np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[number]
        ids = ragged(joined, starts[number], each)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(each)])[bounds[1:]]
        odd = np.add.reduceat(alone[number], bounds[:-1], dtype=np.int64) > 0
        odd |= pc.match_substring(texts, HEAD).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = self._by_pattern(texts[i].as_py())
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def _by_pattern(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._match, self.cut(text))), "<u4")

    def _chunk(self, key: str) -> bytes | None:
        """None if the chunk cannot stand alone."""
        ids = self.old.get(key)
        if ids is None:
            if key.isalpha():
                ids = self.code(" " + key)
            elif key[-1:] in MARKS and key[:-1].isalpha():
                ids = self._match(" " + key[:-1]) + self._match(key[-1])
            else:
                bare = key[1:] if key[:1] in ("\n", HEAD) else key
                if not _solid(bare):
                    return None
                text = bare if key[0] == HEAD else key if key[0] == "\n" else " " + key
                matches = self.cut(text)
                ids = self.code(matches[0]) if len(matches) == 1 else b"".join(map(self._match, matches))
        return self._keep(key, ids)

    def _match(self, match: str) -> bytes:
        # a match's own key: that of the same chunk, or one that no chunk has
        key = match[1:] if match[0] == " " and _solid(match[1:]) and match[1] != HEAD else " " + match
        ids = self.new.get(key)
        if ids is None:
            ids = self.old.get(key)
            ids = self._keep(key, self.code(match) if ids is None else ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= LONGEST:
            self.new[key] = ids
        return ids
