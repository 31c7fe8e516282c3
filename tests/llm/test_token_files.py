import os
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from privtrace.llm import token_files as op
from privtrace.llm.chunks import ChunkCoder, byte_blocks, numbered_words

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
TEXT = st.text(st.sampled_from("ab ethéÄ\n\t\r 12.,'s<|>語🙂\xa0 \0\x1c\x85​"), max_size=60)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(max_size=40)), max_size=4))
def test_chunks_equal_the_library(batch):
    got = op.library_coder(PATH)[0](batch)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ids_of(t) for t in batch]


def test_a_small_table_forgets_and_stays_right():
    coder = op.library_coder(PATH)[0]
    small = ChunkCoder(coder.code, public_tokenizers.PATTERN, remembered=5)
    batch = [f"word{i} and, the {'x' * 80}{i}.\nNext line {i % 3}" for i in range(50)]
    for _ in range(2):
        assert [np.frombuffer(small([t])[0], "<u4").tolist() for t in batch] == [ids_of(t) for t in batch]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t\n\x0b\x0c\ré\xa0\x1c"), max_size=20), max_size=6))
def test_numbered_words(batch):
    number, row, words = numbered_words(pa.array(batch, pa.string()))
    want = [(i, w) for i, t in enumerate(batch) for w in t.encode().split()]
    assert [(int(r), words[n]) for n, r in zip(number, row)] == want


def test_byte_blocks_cover_all():
    a = pa.array(["x" * n for n in (5, 0, 30, 1, 1, 1, 12)])
    assert [x for b in byte_blocks(a, 10) for x in b.to_pylist()] == a.to_pylist()


ROWS = [(5, "five words are in here"), (1, None), (2, ""), (9, "a" * 3000), (3, "Hello, wörld! <|endoftext|>"), (9, "again 9"),
        (None, "no id"), (7, "\n\n  x"), (5, "five words are in here"), (4, "word " * 5000)]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for i, t in order:
        n = len(ids_of(t)) + 1
        out.append((i, n))
        at += n
    return out, at


@pytest.mark.parametrize("length", [7, 2048])
def test_documents_from_the_files(spark, docs, length):
    manifest = op.write_token_files(docs(ROWS), length=length)
    got = sorted(op.read_documents(manifest).collect(), key=lambda r: r.start)
    want, total = expected(ROWS)
    assert sorted(got, key=lambda r: r.start)[0].start == 0
    assert [r.doc_id for r in got] == [i for i, _ in want]
    # documents follow one another without a gap
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == total == sum(m.n_tokens for m in manifest.collect())
    sums = {(i, len(ids_of(t)) + 1, crc32(np.array([*ids_of(t), 2], "<u4").tobytes())) for i, t in ROWS}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == sums


def test_sequences_and_masks(spark, docs):
    manifest = op.write_token_files(docs(ROWS), length=16)
    rows = sorted(op.read_sequences(manifest).collect(), key=lambda r: (r.part, r.sequence))
    assert all(len(r.ids) == len(r.mask) == 16 for r in rows)
    stream = [i for r in rows for i, m in zip(r.ids, r.mask) if m]
    by_start = sorted(op.read_documents(manifest).collect(), key=lambda r: r.start)
    assert len(stream) == sum(r.n_tokens for r in by_start)
    for r in by_start:
        assert crc32(np.array(stream[r.start:r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    # only the end of a file is padded
    for a, b in zip(rows, rows[1:]):
        assert a.part != b.part or all(a.mask)


def test_random_access_without_copies(spark, docs):
    manifest = sorted(op.write_token_files(docs(ROWS), length=8).collect(), key=lambda r: -r.n_tokens)
    f = op.SequenceFile(manifest[0].path)
    ids, mask = f.sequence(0)
    assert ids.dtype == np.uint16 and not ids.flags.owndata and len(ids) == len(mask) == 8
    whole = np.concatenate([f.sequence(i)[0] for i in range(manifest[0].n_sequences)])
    for start, n in ((0, 3), (5, 20), (1, manifest[0].n_tokens - 1)):
        assert np.array_equal(np.concatenate(list(f.ids(start, n))), whole[start:start + n])
    with pytest.raises(IndexError):
        list(f.ids(0, 8 * manifest[0].n_sequences + 1))
    f.close()


def test_wide_vocabulary_and_long_batches(tmp_path):
    path = str(tmp_path / "x.arrow")
    w = op.SequenceWriter(path, op.id_width(70_000), length=4, batch=3)
    w.add(np.arange(69_000, 69_050))
    w.close()
    f = op.SequenceFile(path)
    assert np.concatenate(list(f.ids(0, 50))).tolist() == list(range(69_000, 69_050))
    ids, mask = f.sequence(12)
    assert ids.dtype == np.uint32 and ids.tolist() == [69_048, 69_049, 0, 0] and mask.to_pylist() == [True, True, False, False]


def test_empty_table_and_other_tokenizers(spark, docs):
    assert op.token_files(docs([])).collect() == []
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    got = op.token_files(docs([(1, "Two words"), (2, None)]), path).collect()
    want = {(i, len(other.encode(t, add_special_tokens=False).ids) + 1) for i, t in ((1, "Two words"), (2, ""))}
    assert {(r.doc_id, r.n_tokens) for r in got} == want


def test_files_of_lost_attempts_are_not_read(spark, docs):
    manifest = op.write_token_files(docs(ROWS))
    before = sorted(op.read_documents(manifest).collect(), key=str)
    folder = os.path.dirname(manifest.first().path)
    with open(os.path.join(folder, "part-000000-lost.arrow"), "wb") as f:
        f.write(b"half a file")
    assert sorted(op.read_documents(manifest).collect(), key=str) == before
