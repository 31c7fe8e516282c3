import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from privtrace.llm import token_counts as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, with_bytes):
    vocab = [("<unk>", 0.0), *pieces] + ([(f"<0x{i:02X}>", 0.0) for i in range(256)] if with_bytes else [])
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=with_bytes))
    return lambda x: len(t.encode("▁" + x.replace(" ", "▁"), add_special_tokens=False).ids) if x else 0


COUNTER = op.Counter(*op.load_pieces(PATH))
LIBRARY = library(*op.load_pieces(PATH))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("the in ab  \n\t.,üé漢🙂▁xyz"), max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == LIBRARY(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab▁c", min_size=1, max_size=3), st.integers(-3, -1).map(float), max_size=8), st.text("abcd ", max_size=14), st.booleans())
def test_ties_and_unknowns(pieces, text, with_border):
    pieces = list(({"▁": -1.0} if with_border else {}) | pieces)
    scored = [(p, float(-1 - len(p) % 3)) for p in pieces]
    assert op.Counter(scored, False).count(text) == library(scored, False)(text)


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 3000), (4, "\n" * 50)]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in op.count_tokens(docs(rows)).collect())
    assert got == sorted((i or 0, LIBRARY(t or "")) for i, t in rows)
    assert op.count_tokens(docs([])).collect() == []
