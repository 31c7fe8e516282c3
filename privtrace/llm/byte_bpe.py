"""Byte-level BPE by dynamic programming over prefixes.

A token sequence is the encoding of its bytes exactly if each two neighbours
are the encoding of theirs. So every prefix of a piece has one valid last
token: the one that ends there and is a valid neighbour of the last token of
the prefix before it. The coder stores that token per prefix. Appending bytes
adds prefixes and changes none; after an edit the prefixes before it stand, and
behind it only those are computed again until the stored tokens of one token
length agree with the new ones.

Texts are cut by the tokenizer's pattern and pieces are coded separately; the
chunks of ``chunks`` are coded once per block and remembered in a table of
bounded size per Python worker.

Cases: a null text counts as empty and has no token. Any other text, of any
length, is coded whole. Repeated rows give repeated results, an empty table an
empty one.
"""
from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCoder, ragged
from .rows import map_texts, texts

#: Pairs of tokens that a coder remembers, in each of two halves; small, as a worker lives on beside other stages.
PAIRS = 60_000
#: Bytes of text coded together.
BLOCK = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Last bytes by which the sizes of tokens are looked up.
TAIL = 4


def _sizes_by_tail(ranks: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """By the last TAIL bytes before a place: the sizes of the tokens that can end there, longest first.

    Where a tail is missing, only tokens shorter than it can.
    """
    found: dict[bytes, set[int]] = {}
    for token in ranks:
        if len(token) >= TAIL:
            found.setdefault(token[-TAIL:], set()).add(len(token))
    known: dict[tuple, tuple] = {}  # equal tuples are held once
    short = range(TAIL - 1, 0, -1)
    out = {}
    for tail, sizes in found.items():
        own = (*sorted(sizes, reverse=True), *[n for n in short if tail[-n:] in ranks])
        out[tail] = known.setdefault(own, own)
    return out


class PrefixCoder:
    """Encodes bytes by rank; ``last[i]`` is the last token of the first i bytes.

    Ranks have to be in merge order, as learning gives them: a token is made of
    tokens of lower rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._sizes = _sizes_by_tail(ranks)
        self._sound: set[int] = set()  # tokens that merging makes, as far as met
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._step = max(self.tokens, default=0) + 1
        self._fits: dict[int, bool] = {}  # by a * step + b, in two halves
        self._older: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte, (-1, -1) if merging never makes it."""
        if token not in self._halves:
            whole, found = self.tokens[token], None
            if len(whole) > 1:
                parts = [whole[i:i + 1] for i in range(len(whole))]
                while len(parts) > 2:
                    best = min(((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)))
                    if best[0] >= token:
                        break
                    i = best[1]
                    parts[i:i + 2] = [parts[i] + parts[i + 1]]
                found = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else (-1, -1)
            self._halves[token] = found
        return self._halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as exactly a, b.

        A merge across the border happens if it ranks before the merge that
        takes one of its sides away. The pairs that meet at the border are
        those of a's right ends and b's left ends, walked from the latest made
        to the first. Of merges with equal rank the left one happens first.
        """
        pair = a * self._step + b
        known = self._fits.get(pair)
        if known is None and (known := self._older.get(pair)) is not None:
            self._fits[pair] = known
        if known is not None:
            return known
        x, y, limit, ok = a, b, 1 << 60, True
        while ok:
            across = self.ranks.get(self.tokens[x] + self.tokens[y])
            if across is not None and across < limit:
                ok = False
                break
            hx, hy = self.halves(x), self.halves(y)
            if hx is None and hy is None:
                break
            if hy is None or (hx is not None and x > y):
                limit, x = x, hx[1]
            else:
                limit, y = y + 1, hy[0]  # the merge across lies left of b's own and wins a tie
        if len(self._fits) >= PAIRS:
            self._older, self._fits = self._fits, {}
        self._fits[pair] = ok
        return ok

    def _last(self, data: bytes, last: list[int], i: int) -> int:
        get, tokens = self.ranks.get, self.tokens
        for n in range(min(i, self.longest), 0, -1):
            t = get(data[i - n:i])
            if t is not None and self._made(t) and (n == i or self.fits(last[i - n], t)):
                return t
        raise ValueError("a byte has no token")

    def prefixes(self, data: bytes) -> list[int]:
        return self.extend(b"", [-1], data)

    def extend(self, data: bytes, last: list[int], more: bytes) -> list[int]:
        """The prefix tokens of data + more, from those of data."""
        last, data = list(last), data + more
        rank, step, fits, sizes, sound = self.ranks.get, self._step, self.fits, self._sizes.get, self._sound
        short = tuple(range(TAIL - 1, 0, -1))
        for i in range(len(last), len(data) + 1):
            near = self._fits
            for n in sizes(data[i - TAIL:i], short) if i >= TAIL else range(i, 0, -1):
                start = i - n
                if start < 0:
                    continue
                t = rank(data[start:i])
                if t is None:
                    continue
                if start and n > 1:  # one token is valid, so a single byte is where no longer one was
                    # the pairs met most are looked up here, without a call
                    met = near.get(last[start] * step + t)
                    if not (fits(last[start], t) if met is None else met):
                        continue
                if t in sound or self._made(t):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte has no token")
        return last

    def _made(self, token: int) -> bool:
        """Whether merging ever makes the token."""
        if self.halves(token) == (-1, -1):
            return False
        self._sound.add(token)
        return True

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replace data[start:stop]: the new bytes, their prefix tokens, and how many prefixes were computed."""
        out = data[:start] + new + data[stop:]
        now, shift, same, made = list(last[:start + 1]), len(new) - (stop - start), 0, 0
        for i in range(start + 1, len(out) + 1):
            t = self._last(out, now, i)
            now.append(t)
            made += 1
            before = i - shift
            # as many agreeing prefixes as the longest token has bytes decide all later ones
            same = same + 1 if before - self.longest >= stop and before <= len(data) and last[before] == t else 0
            if same >= self.longest:
                now.extend(last[before + 1:])
                break
        return out, now, made

    def tokens_of(self, last: list[int]) -> list[int]:
        """Follow the prefix tokens back from the end."""
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.halves(whole) != (-1, -1):
            return [whole]
        return self.tokens_of(self.prefixes(data))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in one array, and by id where they start and how many they are."""
        top = max(self.tokens, default=-1) + 1
        sizes = np.array([len(self.tokens.get(i, b"")) for i in range(top)], np.int64)
        return np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8), np.cumsum(sizes) - sizes, sizes


_CODERS: dict[tuple, tuple] = {}


def _coder(path: str, pattern: str | None = None):
    """The coder of a rank file and its chunks, one per Python worker."""
    if (path, pattern) not in _CODERS:
        coder = PrefixCoder(load_ranks(path))

        def code(match: str) -> bytes:
            tokens = coder.encode(match.encode())
            return struct.pack(f"<{len(tokens)}I", *tokens)

        # the cuts of a chunk hold for this pattern only; any other one cuts every text itself
        sure = pattern in (None, _files("", None)[1])
        _CODERS[path, pattern] = (coder, ChunkCoder(code, pattern or "", block=BLOCK, every_text=not sure))
    return _CODERS[path, pattern]


def encode_texts(batch: list[str], path: str, pattern) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    return _coder(path, pattern.pattern)[1](batch)


def _files(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken") if path is None else path, public_tokenizers.PATTERN if pattern is None else pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text."""
    path, pattern = _files(path, pattern)

    def start():
        coder = _coder(path, pattern)[1]
        return lambda batch: [[np.frombuffer(b, "<u4").astype(np.int32) for b in coder(batch)]]

    return map_texts(texts(docs, id_col, text_col), "ids array<int>", start)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``bytes`` from doc_id and ``ids``; null ids count as none."""
    path, _ = _files(path, "")

    def run(batches):
        coder = _coder(path)[0]
        for b in batches:
            data = [coder.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay inside the task."""
    path, pattern = _files(path, pattern)

    def start():
        from hashlib import sha256

        ranks, coder = _coder(path, pattern)
        spelled, starts, sizes = ranks.spelling()

        def each(batch: pa.Array) -> list:
            counts, sums, back = [], [], []
            for ids, ends in coder.blocks(batch):
                n = sizes[ids]
                decoded = ragged(spelled, starts[ids], n)
                cuts = np.concatenate([[0], np.cumsum(n)])[ends]
                at = was = 0
                for end, cut in zip(ends.tolist(), cuts.tolist()):
                    counts.append(end - at)
                    sums.append(sha256(ids[at:end]).hexdigest())
                    back.append(sha256(decoded[was:cut]).hexdigest())
                    at, was = end, cut
            return [counts, sums, back]
        return each

    return map_texts(texts(docs, id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", start, arrow=True)
