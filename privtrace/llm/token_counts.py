"""Token counts under a unigram vocabulary: Viterbi over automaton matches, counting only.

An Aho-Corasick automaton names every vocabulary piece that ends at a place.
Per place the best score of a path and the number of its pieces are carried; no
path is stored. Rules of the tokenizer: a path's score is the sum of its
pieces' scores; of equal scores the one found first stays, which is the one
whose last piece starts earlier; a character that is no piece by itself may be
taken as unknown at the lowest score less 10; unknown characters are counted by
their UTF-8 bytes if the vocabulary has byte pieces, else each run of them is
one. Blanks become the border sign, and one is put before the text.

No piece holds a border sign behind another character, so paths meet at the
beginning of each word and words are counted separately and remembered, in a
table of bounded size. A vocabulary for which this doesn't hold is run over the
whole text.

Cases: null and empty texts have no tokens. A text of any length is counted
whole. Repeated rows give equal counts, an empty table an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .rows import map_texts, texts

BORDER = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a Python worker remembers.
KNOWN = 250_000


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces of a vocabulary file with their scores, and whether it has all byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i) or m.is_byte(i))]
    return pieces, sum(map(m.is_byte, ids)) == 256


class Counter:
    """Counts the pieces of the best path through a text."""

    def __init__(self, pieces: Sequence[tuple[str, float]], bytes_for_unknown: bool):
        import ahocorasick

        self.bytes_for_unknown = bytes_for_unknown
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        inner = any(BORDER in p.lstrip(BORDER) for p, _ in pieces)
        self.words = None
        if not inner and BORDER in self.single:
            # a character of no piece stands alone on every path, so a line break parts words too
            line = "" if any("\n" in p for p, _ in pieces) or not bytes_for_unknown else "\n"
            self.words = re.compile(f"{BORDER}+[^{BORDER}{line}]*|[^{BORDER}{line}]+" + (f"|{line}" if line else ""))
        self.known: dict[str, int] = {}

    def best(self, text: str) -> int:
        """The number of pieces on the best path through ``text``."""
        n = len(text)
        if not n:
            return 0
        ends: dict[int, list] = {}
        if not self.empty:
            for end, piece in self.automaton.iter(text):
                ends.setdefault(end + 1, []).append(piece)
        score, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, size = None, 0
            for length, gain in sorted(ends.get(e, ()), reverse=True):  # earlier starts first
                s = score[e - length] + gain
                if top is None or s > top:
                    top, size = s, length
            if text[e - 1] not in self.single:
                s = score[e - 1] + self.unknown
                if top is None or s > top:
                    top, size = s, 0
            score[e] = top
            if size:
                count[e] = count[e - size] + 1
            else:
                lost[e] = True
                count[e] = count[e - 1] + (len(text[e - 1].encode()) if self.bytes_for_unknown else not lost[e - 1])
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = BORDER + text.replace(" ", BORDER)
        if self.words is None:
            return self.best(text)
        total, known = 0, self.known
        for word in self.words.findall(text):
            got = known.get(word)
            if got is None:
                got = self.best(word)
                if len(word) <= 64:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[word] = got
            total += got
        return total


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(*load_pieces(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def start():
        counter = _counter(path)
        return lambda batch: [list(map(counter.count, batch))]

    return map_texts(texts(docs, id_col, text_col), "n_tokens long", start)
