from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from privtrace.llm import byte_bpe as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = op.load_ranks(PATH)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = op.PrefixCoder(RANKS)
TEXT = st.text(st.sampled_from("ab ethéÄ\n\t 12.,'s<|>語🙂\xa0\u2028"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=40)))
def test_encoding_equals_the_library(text):
    import regex
    got = op.encode_texts([text], PATH, regex.compile(public_tokenizers.PATTERN))[0]
    assert np.frombuffer(got, "<u4").tolist() == TIK.encode_ordinary(text)


def merged(data, ranks):
    """Plain rank merging."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 60:
            break
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def learned(sample, merges):
    """Ranks in the order in which merging learns them from a sample."""
    ranks, parts = {b"a": 0, b"b": 1}, [bytes([c]) for c in sample]
    for _ in range(merges):
        pairs = sorted({(-sum(parts[j:j + 2] == parts[i:i + 2] for j in range(len(parts) - 1)), parts[i] + parts[i + 1]) for i in range(len(parts) - 1)})
        pairs = [p for _, p in pairs if p not in ranks]
        if not pairs:
            break
        ranks[pairs[0]] = len(ranks)
        out, i = [], 0
        while i < len(parts):
            step = 2 if i + 1 < len(parts) and parts[i] + parts[i + 1] == pairs[0] else 1
            out.append(b"".join(parts[i:i + step]))
            i += step
        parts = out
    return ranks


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=2, max_size=40), st.integers(0, 12), st.text("ab", max_size=40))
def test_small_vocabularies_with_ties(sample, merges, text):
    ranks = learned(sample.encode(), merges)
    assert op.PrefixCoder(ranks).encode(text.encode()) == merged(text.encode(), ranks)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=50), st.binary(max_size=20))
def test_appending(a, b):
    last = CODER.prefixes(a)
    assert CODER.extend(a, last, b) == CODER.prefixes(a + b)


@settings(max_examples=100, deadline=None)
@given(st.text("abc thering", min_size=0, max_size=400), st.integers(0, 400), st.integers(0, 30), st.text("xyz the", max_size=10))
def test_edits(text, start, gone, new):
    data = text.encode()
    start = min(start, len(data))
    stop = min(len(data), start + gone)
    out, last, _ = CODER.edit(data, CODER.prefixes(data), start, stop, new.encode())
    assert out == data[:start] + new.encode() + data[stop:] and last == CODER.prefixes(out)


def test_an_edit_computes_few_prefixes():
    data = ("the quick brown fox " * 400).encode()
    out, last, made = CODER.edit(data, CODER.prefixes(data), 50, 51, b"Z")
    assert made < 1000 and CODER.decode(CODER.tokens_of(last)) == out


def test_digests_and_round_trip(docs):
    rows = [(1, None), (2, ""), (3, "Hello, wörld! <|endoftext|>"), (4, "a" * 5000), (5, " \n\n x"), (5, " \n\n x"), (None, "id")]
    df = docs(rows)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.token_digests(df).collect()}
    want = set()
    for i, t in rows:
        ids = TIK.encode_ordinary(t or "")
        want.add((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = op.decode(op.encode(df))
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in back.collect()} == {(i, t or "") for i, t in rows}
    assert op.token_digests(docs([])).collect() == []


def test_a_byte_without_token():
    with pytest.raises(ValueError):
        op.PrefixCoder({b"a": 0}).encode(b"b")


def test_prefixes_try_only_sizes_that_can_end_there():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    ranks = {bytes([i]): i for i in range(256)}
    for n in range(2, 41):  # one long chain of merges: tokens of up to 40 bytes
        ranks[b"a" * (n - 1) + b"b" if n > 2 else b"ab"] = len(ranks)
    coder = op.PrefixCoder(Counted(ranks))
    data = b"the quick brown fox jumps over the lazy dog " * 20
    Counted.asked = 0
    assert coder.decode(coder.tokens_of(coder.prefixes(data))) == data
    assert Counted.asked < 4 * len(data)


def test_words_met_again_are_not_coded_again(monkeypatch):
    from privtrace.llm import byte_bpe
    monkeypatch.setattr(byte_bpe, "_CODERS", {})
    coder = byte_bpe._coder(*byte_bpe._files(None, None))[1]
    calls = []
    monkeypatch.setattr(coder, "code", lambda match: calls.append(match) or b"\0\0\0\0")
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:240_000]
    parts = [" ".join(words[k:k + 80_000]) for k in range(0, 240_000, 80_000)]
    for part in [*parts, parts[0]]:
        coder([part])
    assert len(calls) < 240_100
