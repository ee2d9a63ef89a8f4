"""Token ids as Arrow stream files of equal-length sequences.

Documents are sorted by id over the cluster. Each task of the sort encodes its documents, appends the end id to each and
writes one file of ids: an uncompressed Arrow stream of two fixed-size-list columns, `ids` (16-bit numbers where the
vocabulary allows it, else 32-bit) and `mask` (true for an id, false for the padding that ends a file; a bit each). All batches but the last
hold `rows_per_batch` sequences, so that a sequence's batch is known from its number, and a mapped file gives its ids
without a copy (`TokenFile.sequence`). Beside it stands a stream of its documents (doc_id, start in the file, n_tokens),
because an end id may also be an ordinary token.

Files are written under a name of their own by every attempt of a task; the manifest, a Parquet table with one row for
each file, names only those of attempts that Spark has accepted. So a lost executor repeats single tasks, and what its
first attempt left behind is never read. The folder may be any that pyarrow.fs can open (a local path, file, hdfs, s3 ...).

Defined cases: a null text is an empty one; an empty document is its end id alone. A null id comes last. Rows that
repeat an id are documents each, in the order in which the input holds them; however many they are, they are spread over
tasks. An empty table gives an empty manifest and no files. Other columns aren't read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.sources.work import new_folder

WIDTH, END_ID, ROWS_PER_BATCH = 2048, 1, 64
#: Words, and pieces of words, kept with their ids (twice as many at most); the longest of them, and the text that is cut
#: at a time, in bytes.
KEPT, KEPT_BYTES, CHUNK_BYTES = 400_000, 64, 1 << 21
#: Where texts are cut: between ASCII characters of different kinds, so that what touches another character stays with it.
_BLANK, _MORE = rb" \t\n\r\x0b\x0c", rb"\x80-\xff"
_LETTERS, _OTHERS = rb"'?[A-Za-z]++", rb"[^A-Za-z0-9" + _BLANK + _MORE + rb"]++"
_MIXED = rb"(?:%(l)s|%(o)s)?(?:[%(m)s]++(?:%(l)s|%(o)s)?)++" % {b"l": _LETTERS, b"o": _OTHERS, b"m": _MORE}
PIECES = re.compile(rb"%(l)s(?![%(m)s])|%(x)s|%(o)s|[0-9]" % {b"l": _LETTERS, b"o": _OTHERS, b"m": _MORE, b"x": _MIXED})
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
MANIFEST = "part long, ids_file string, docs_file string, n_docs long, n_tokens long, n_sequences long"


class TextIds:
    """Ids of texts under a tokenizers .json file, as little-endian bytes of `kind`.

    With `by_pieces` texts are cut at ASCII white space, and words into runs of ASCII letters (with an apostrophe before
    them), single digits and runs of other ASCII characters; what touches a character beyond ASCII stays one piece with
    it. Each different piece is encoded once, and the ids of words and pieces are kept. That
    gives the same ids for tokenizers that drop white space and never join what these cuts part; for others whole texts
    are encoded. A word that holds `<|`, as added tokens do, isn't cut.
    """

    def __init__(self, path: str, kind: str, by_pieces: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has a core
        self.tokenizer, self.kind, self.by_pieces = Tokenizer.from_file(path), np.dtype(kind), by_pieces
        self.words, self.pieces = _Recent(), _Recent()
        self.for_letters = self._without_split(path)

    def _without_split(self, path: str):
        """The tokenizer without its first cut, if that is a pattern: it would leave a run of ASCII letters as it is."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        steps = (known.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if len(steps) < 2 or steps[0]["type"] != "Split" or len(self.tokenizer.pre_tokenizer.pre_tokenize_str(ascii_lowercase * 2)) != 1:
            return self.tokenizer
        known["pre_tokenizer"]["pretokenizers"] = steps[1:]
        return Tokenizer.from_str(json.dumps(known))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        on = gc.isenabled()
        gc.disable()  # many lists of bytes, none of them in a cycle
        try:
            return self._all(texts)
        finally:
            if on:
                gc.enable()

    def _all(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_pieces:
            found = self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)
            return [np.array(x.ids, self.kind).tobytes() for x in found]
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > CHUNK_BYTES:
                out += self._encoded(held)
                held, size = [], 0
                out.append(b"".join(x for part in _cut_long(text) for x in self._encoded([part])))
                continue
            held.append(text)
            size += len(text)
            if size > CHUNK_BYTES:
                out += self._encoded(held)
                held, size = [], 0
        return out + self._encoded(held)

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        cut = [text.split() for text in texts]
        new = self.words.missing(set(chain.from_iterable(cut)))
        if new:
            pieces = [[word] if b"<|" in word else PIECES.findall(word) for word in new]
            fresh = self.pieces.missing(set(chain.from_iterable(pieces)))
            self._learn(fresh)
            ids = self.pieces.now
            self.words.now.update(zip(new, [ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for p in pieces], strict=True))
        known = self.words.now
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        self.words.trim(new)
        self.pieces.trim(fresh if new else [])
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        self._learn_by(self.for_letters, [p for p in pieces if p.isalpha()])  # of bytes: ASCII letters
        self._learn_by(self.tokenizer, [p for p in pieces if not p.isalpha()])

    def _learn_by(self, tokenizer, pieces: list[bytes]) -> None:
        if not pieces:
            return
        found = tokenizer.encode([x.decode() for x in pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, self.kind).tobytes()
        ends = (np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(pieces) + 1)) * self.kind.itemsize).tolist()
        self.pieces.now.update(zip(pieces, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))


class _Recent:
    """Ids of what has come up lately: those found since `now` was last full, and before them those of the time before."""

    def __init__(self) -> None:
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """The keys that aren't known; the others are in `now` from here on."""
        new, old = keys.difference(self.now), self.before
        self.now.update([(k, old[k]) for k in new if k in old])
        return [k for k in new if k not in old]

    def trim(self, new: list[bytes]) -> None:
        """Forget long keys, and the older half once `now` is full."""
        for k in new:
            if len(k) > KEPT_BYTES:
                self.now.pop(k, None)
        if len(self.now) > KEPT:
            self.now, self.before = {}, self.now


def _cut_long(text: bytes) -> Iterator[bytes]:
    """A text in parts that end at white space, of about CHUNK_BYTES where there is any."""
    start = 0
    while start < len(text):
        found = SPACE.search(text, start + CHUNK_BYTES)
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end


@lru_cache(4)
def _text_ids(path: str, kind: str, by_pieces: bool) -> TextIds:
    """One for each Python worker, so that its tasks share the pieces."""
    return TextIds(path, kind, by_pieces)


def id_kind(path: str, end_id: int = END_ID) -> str:
    """The numpy type of the ids in a file."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def _open(path: str, write: bool = False):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if write:
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner)
    return pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner)


class _SequenceWriter:
    """Ids that come in pieces, as batches of whole sequences."""

    def __init__(self, path: str, kind: str, width: int, rows: int):
        self.kind, self.width, self.size = np.dtype(kind), width, rows * width
        value = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(value, width)), ("mask", pa.list_(pa.bool_(), width))])
        self.file = _open(path, write=True)
        self.out = pa.ipc.new_stream(self.file, self.schema)
        self.held: list[bytes] = []
        self.bytes, self.sequences = 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.size * self.kind.itemsize:
            flat = np.frombuffer(b"".join(self.held), self.kind)
            whole = len(flat) - len(flat) % self.size
            for i in range(0, whole, self.size):
                self._write(flat[i : i + self.size])
            self.held = [flat[whole:].tobytes()]
            self.bytes = len(self.held[0])

    def _write(self, flat: np.ndarray) -> None:
        pad = -len(flat) % self.width
        mask = np.arange(len(flat) + pad) < len(flat)
        flat = np.concatenate([flat, np.zeros(pad, self.kind)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += len(columns[0])

    def close(self) -> None:
        if self.bytes:
            self._write(np.frombuffer(b"".join(self.held), self.kind))
        self.out.close()
        self.file.close()


class TokenFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        self.file = _open(path)
        self.batches = list(pa.ipc.open_stream(self.file))  # of a mapped file: places in it, no copies
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of the i-th sequence, as views of the file."""
        batch, row = self.batches[i // self.rows], i % self.rows
        ids, mask = (batch.column(c).slice(row, 1).flatten() for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                      end_id: int = END_ID, rows_per_batch: int = ROWS_PER_BATCH, by_pieces: bool = True) -> DataFrame:
    """Write the documents' ids in ascending order of doc_id; returns the manifest (its columns: MANIFEST, and first_token,
    the number of ids in all files before).
    """
    spark = docs.sparkSession
    folder = folder.rstrip("/") if folder else new_folder(spark, "token_files")
    kind = id_kind(tokenizer, end_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("__row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__row").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.col("text").cast("binary").alias("text"))
    names = [part.split()[0] for part in MANIFEST.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _text_ids(tokenizer, kind, by_pieces), np.array([end_id], kind).tobytes()
        part, size = TaskContext.get().partitionId(), len(end)
        name = f"{folder}/files/part-{part:06d}-{uuid.uuid4().hex}"
        ids = index = None
        start = n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                ids = _SequenceWriter(f"{name}.ids.arrow", kind, width, rows_per_batch)
                schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index_file = _open(f"{name}.docs.arrow", write=True)
                index = pa.ipc.new_stream(index_file, schema)
            found = encode(batch.column(1).to_pylist())
            for one in found:
                ids.add(one)
                ids.add(end)
            lengths = np.array([len(one) // size + 1 for one in found], np.int64)
            starts = start + np.cumsum(lengths) - lengths
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(lengths)], schema=schema))
            start, n_docs = start + int(lengths.sum()), n_docs + batch.num_rows
        if ids is not None:
            ids.close()
            index.close()
            index_file.close()
            values = (part, f"{name}.ids.arrow", f"{name}.docs.arrow", n_docs, start, ids.sequences)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return token_manifest(spark, folder)


def token_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder that write_token_files() has filled."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _a_task_each(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, manifest.count()))


def read_documents(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """Each document from the files: doc_id (of the type `kind`), start, n_tokens, ids_crc32 (of unsigned 32-bit ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = _masked_ids(TokenFile(row["ids_file"]))
                piece = np.zeros(0, np.uint32)
                with _open(row["docs_file"]) as file:
                    for docs in pa.ipc.open_stream(file):
                        sums = np.zeros(docs.num_rows, np.int64)
                        for i, n in enumerate(docs.column("n_tokens").to_pylist()):
                            crc = 0
                            while n > len(piece):
                                crc, n = zlib.crc32(piece.tobytes(), crc), n - len(piece)
                                piece = next(pieces)
                            sums[i], piece = zlib.crc32(piece[:n].tobytes(), crc), piece[n:]
                        start = pa.array(docs.column("start").to_numpy() + row["first_token"])
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    files = _a_task_each(manifest).select("ids_file", "docs_file", "first_token")
    return files.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _masked_ids(file: TokenFile) -> Iterator[np.ndarray]:
    """The ids of a file without its padding, a batch at a time, as 32-bit numbers."""
    for batch in file.batches:
        ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()
        yield (ids if mask.true_count == len(ids) else ids[mask.to_numpy(zero_copy_only=False)]).astype("<u4")


def read_sequences(manifest: DataFrame) -> DataFrame:
    """Each sequence of the files: part, sequence (its number in the file), ids and mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = 0
                for found in TokenFile(row["ids_file"]).batches:
                    n, width = found.num_rows, found.column("ids").type.list_size
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                    ids, mask = (pa.ListArray.from_arrays(offsets, found.column(c).flatten().cast(t)) for c, t in (("ids", pa.int64()), ("mask", pa.bool_())))
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n), pa.array(np.arange(at, at + n)), ids, mask], ["part", "sequence", "ids", "mask"])
                    at += n

    return _a_task_each(manifest).mapInArrow(read, "part long, sequence long, ids array<long>, mask array<boolean>")
