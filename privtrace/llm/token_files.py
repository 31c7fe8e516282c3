"""Token ids in Arrow files of equal-length sequences with masks, read back without copies.

Documents are dealt into ranges of ascending id. Each task encodes its range
with the ``tokenizers`` library, appends the end id to every document, packs
the ids into sequences of a fixed length and writes one Arrow file: record
batches of a fixed-size-list column ``ids`` (16 bits wide if the vocabulary
allows) and one ``mask``, false only in the padding of the file's last
sequence. A small Arrow file beside it lists the documents with their place.
Batches hold the same number of sequences, so that sequence i is found by
division, and a reader that maps the file gets it as a view.

The manifest, a table written by Spark, names the files of the task attempts
that succeeded; files of lost attempts have other names and are never read.

Cases: a null text counts as empty and is the end id alone. Texts of any length
are encoded whole; a long document goes over many sequences. Documents of the
same id follow one another in the order of their texts' hashes, then texts; a
null id comes first. An empty table gives no file and an empty result. Other
columns are ignored.
"""
from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, new_work_path
from .chunks import ChunkCoder
from .rows import texts

#: Ids in a sequence.
LENGTH = 2048
#: Sequences in a record batch.
BATCH = 256

MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long, n_sequences long"


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def id_width(vocabulary: int):
    """The narrowest of the two kinds of ids."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Packs ids into sequences; at most one record batch is held."""

    def __init__(self, path: str, kind, length: int = LENGTH, batch: int = BATCH):
        import numpy as np

        self.np, self.length, self.size, self.fill, self.n = np, length, length * batch, 0, 0
        self.buffer = np.zeros(self.size, kind.to_pandas_dtype())
        system, inner = file_system(path)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))],
                                {"sequences_a_batch": str(batch)})
        self.sink = system.open_output_stream(inner)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.sequences = 0

    def add(self, ids) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.size - self.fill)
            self.buffer[self.fill:self.fill + take] = ids[at:at + take]
            self.fill, at = self.fill + take, at + take
            if self.fill == self.size:
                self._flush()
        self.n += len(ids)

    def _flush(self) -> None:
        rows = -(-self.fill // self.length)
        if rows:
            values = self.buffer[:rows * self.length].copy()
            values[self.fill:] = 0
            mask = self.np.arange(rows * self.length) < self.fill
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
            self.sequences, self.fill = self.sequences + rows, 0

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of a file; local files are mapped and nothing is copied."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        local = type(system).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(inner) if local else system.open_input_file(inner)
        self.reader = pa.ipc.open_file(self.source)
        self.each = int(self.reader.schema.metadata[b"sequences_a_batch"])
        self.length = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _load(self, k: int):
        if k != self._at:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch

    def sequence(self, i: int):
        """The ids (a numpy view) and the mask (an Arrow array) of sequence i."""
        b, row = self._load(i // self.each), i % self.each
        at = row * self.length
        ids = b.column("ids").values.to_numpy(zero_copy_only=True)[at:at + self.length]
        return ids, b.column("mask").values.slice(at, self.length)

    def ids(self, start: int, n: int) -> Iterator:
        """Views of n ids from position ``start`` of the file, one per record batch that they touch."""
        size = self.each * self.length
        while n > 0:
            values = self._load(start // size).column("ids").values.to_numpy(zero_copy_only=True)
            at = start % size
            view = values[at:at + n]
            if not len(view):
                raise IndexError("beyond the end of the file")
            yield view
            start, n = start + len(view), n - len(view)

    def close(self) -> None:
        self._batch = None
        self.source.close()


_CODERS: dict[str, tuple] = {}


def _byte_letters() -> list[str]:
    """The character by which the byte-level vocabulary writes each byte: itself if it shows, else the next free one."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WholeTexts:
    """Codes every text by one call of the library."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def blocks(self, texts: pa.Array):
        import numpy as np

        for at in range(0, len(texts), 64):
            got = self.tokenizer.encode_batch(texts.slice(at, 64).to_pylist(), add_special_tokens=False)
            ids = [np.array(e.ids, "<u4") for e in got]
            yield np.concatenate(ids), np.cumsum([len(x) for x in ids])


def library_coder(path: str):
    """(coder of texts, vocabulary size); one per Python worker.

    A byte-level tokenizer's model codes each distinct chunk once; any other
    tokenizer gets the texts whole. Strings of special tokens are ordinary text.
    """
    if path not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        import struct

        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        made = json.loads(tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        if (made["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"]
                and not before["add_prefix_space"]):
            letters, model = dict(enumerate(_byte_letters())), tokenizer.model

            def code(match: str) -> bytes:
                ids = [t.id for t in model.tokenize(match.encode().decode("latin-1").translate(letters))]
                return struct.pack(f"<{len(ids)}I", *ids)

            coder = ChunkCoder(code, public_tokenizers.PATTERN)
        else:
            coder = WholeTexts(tokenizer)
        _CODERS[path] = (coder, tokenizer.get_vocab_size())
    return _CODERS[path]


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, length: int = LENGTH,
                      folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return their manifest, one row per file; ``folder`` is a shared one."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = folder or new_work_path(spark, "token-files")
    t = texts(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "__h", "text"]
    ranged = t.withColumn("__h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "__h").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import numpy as np
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        coder, vocabulary = library_coder(path)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        target = f"{folder}/part-{part:06d}-{name}.arrow"
        beside = target.removesuffix(".arrow") + ".index.arrow"
        out = index = sink = None
        n_docs = 0
        schema = pa.schema([("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                system, inner = file_system(target)
                system.create_dir(os.path.dirname(inner), recursive=True)
                out = SequenceWriter(target, id_width(max(vocabulary, end_id + 1)), length)
                sink = system.open_output_stream(file_system(beside)[1])
                index = pa.ipc.new_file(sink, schema)
            at = 0
            for ids, ends in coder.blocks(b.column("text")):
                sizes = np.diff(ends, prepend=0) + 1
                place = out.n + np.cumsum(sizes) - sizes
                out.add(np.insert(ids, ends, end_id))
                rows = [b.column("doc_id").slice(at, len(ends)), pa.array(place, pa.int64()), pa.array(sizes, pa.int64())]
                index.write_batch(pa.record_batch(rows, schema=schema))
                at += len(ends)
            n_docs += b.num_rows
        if out is not None:
            out.close()
            index.close()
            sink.close()
            row = [[part], [target], [beside], [n_docs], [out.n], [out.sequences]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    return cut(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids of all earlier files, dealt one file a task.

    There are as many files as tasks wrote them, a number that the driver handles anyway.
    """
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((*r, base))
        base += r["n_tokens"]
    spark = manifest.sparkSession
    return spark.createDataFrame(rows, f"{MANIFEST}, base long").repartitionByRange(max(1, len(rows)), "part")


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    kind = id_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import numpy as np

        for b in batches:
            for path, beside, base in zip(*(b.column(c).to_pylist() for c in ("path", "index_path", "base"))):
                tokens = SequenceFile(path)
                system, inner = file_system(beside)
                with system.open_input_file(inner) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        sums = []
                        for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            crc = 0
                            for view in tokens.ids(start, n):
                                crc = crc32(np.ascontiguousarray(view, "<u4"), crc)
                            sums.append(crc)
                        starts = pa.array([s + base for s in docs.column("start").to_pylist()], pa.int64())
                        yield pa.record_batch([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(sums, pa.int64())],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32"])
                tokens.close()

    return _placed(manifest).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_sequences(manifest: DataFrame) -> DataFrame:
    """part, sequence (its number in the file), ids, mask: what a training job reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist()):
                tokens, at = SequenceFile(path), 0
                for k in range(tokens.reader.num_record_batches):
                    rows = tokens.reader.get_batch(k)
                    n = rows.num_rows
                    yield pa.record_batch([
                        pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()),
                        rows.column("ids").cast(pa.list_(pa.int32())), rows.column("mask").cast(pa.list_(pa.bool_()))],
                        names=["part", "sequence", "ids", "mask"])
                    at += n
                tokens.close()

    return _placed(manifest).mapInArrow(run, "part int, sequence long, ids array<int>, mask array<boolean>")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, length: int = LENGTH,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, read back: doc_id, start, n_tokens, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()
    return read_documents(write_token_files(docs, path, end_id, length, id_col=id_col, text_col=text_col), kind)
