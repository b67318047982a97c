"""Token files: Arrow stream files of equal-length sequences and masks.

A file holds the ids of a range of documents, one after the other, as record
batches of two fixed-size lists: ``ids`` (``length`` ids a sequence, unsigned,
16 bits if the vocabulary allows, else 32) and ``mask`` (one bit an id, false
in the padding that ends the file's last sequence). Memory-mapped, any
sequence can be read in place. Beside it lies an index file, also an Arrow
stream: doc_id, first id and number of ids of each document, in file order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import doc_texts, materialise, shuffle_width
from quire.llm.word_tokens import encoder
from quire.session import fresh_path

LENGTH = 2048
_ROWS = 64  # sequences in a record batch
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _file_system(path: str):
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])


def file_schema(length: int = LENGTH, bits: int = 16) -> pa.Schema:
    ids = pa.uint16() if bits == 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


def id_bits(largest: int) -> int:
    return 16 if largest <= np.iinfo(np.uint16).max else 32


class TokenFileWriter:
    """Streams ids into one file; memory holds one record batch."""

    def __init__(self, path: str, length: int = LENGTH, bits: int = 16):
        self.schema, self.length = file_schema(length, bits), length
        self.kind = np.dtype("<u2" if bits == 16 else "<u4")
        self.fs, self.path = _file_system(path)
        self.out = self.fs.open_output_stream(self.path)
        self.index_out = self.fs.open_output_stream(self.path + ".index")
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.index = pa.ipc.new_stream(self.index_out, _INDEX)
        self.held: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.n_held = self.n_ids = self.n_docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"id {int(ids.max())} does not fit {8 * self.kind.itemsize} bits")
        self.rows.append((doc_id, self.n_ids, len(ids)))
        self.held.append(ids.astype(self.kind))
        self.n_ids += len(ids)
        self.n_docs += 1
        self.n_held += len(ids)
        if self.n_held >= self.length * _ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        whole = len(ids) // self.length * self.length
        rest = ids[whole:]
        if last and len(rest):
            ids = np.concatenate([ids, np.zeros(self.length - len(rest), self.kind)])
            n, whole = len(self.held) and whole + len(rest), len(ids)
        else:
            n = whole
        for k in range(0, whole, self.length * _ROWS):
            part = ids[k:min(whole, k + self.length * _ROWS)]
            mask = np.arange(k, k + len(part)) < n
            self.writer.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(part), type=self.schema.field(0).type),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field(1).type)],
                schema=self.schema))
        self.held, self.n_held = ([], 0) if last else ([rest], len(rest))
        if self.rows:
            doc_id, start, n_tokens = zip(*self.rows)
            self.index.write_batch(pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (doc_id, start, n_tokens)], schema=_INDEX))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        for x in (self.writer, self.index, self.out, self.index_out):
            x.close()


class TokenFile:
    """Random access to a token file; local files are mapped, not copied."""

    def __init__(self, path: str):
        from pyarrow import fs
        filesystem, at = _file_system(path)
        if isinstance(filesystem, fs.LocalFileSystem):
            self.source = pa.memory_map(at)
        else:
            self.source = filesystem.open_input_file(at)
        reader = pa.ipc.open_stream(self.source)
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)
        rows = np.array([b.num_rows for b in self.batches], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(rows)])
        with filesystem.open_input_stream(at + ".index") as f:
            self.index = pa.ipc.open_stream(f).read_all()

    def __len__(self) -> int:
        return int(self.first[-1])

    def _values(self, k: int) -> np.ndarray:
        b = self.batches[k]
        return b.column(0).values.to_numpy(zero_copy_only=True)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids in place, mask) of one sequence."""
        k = int(np.searchsorted(self.first, row, "right")) - 1
        at = (row - int(self.first[k])) * self.length
        mask = self.batches[k].column(1).values.slice(at, self.length).to_numpy(zero_copy_only=False)
        return self._values(k)[at:at + self.length], mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ``n`` ids from place ``start`` on."""
        out = []
        while n:
            row, skip = divmod(start, self.length)
            k = int(np.searchsorted(self.first, row, "right")) - 1
            at = start - int(self.first[k]) * self.length
            got = self._values(k)[at:at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2,
                      length: int = LENGTH, bits: int | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and write the ids in
    ascending doc_id order. Returns the manifest, one row a file: (part, path,
    n_docs, n_ids, base), ``base`` being the number of ids in earlier files.

    Documents are range-partitioned by doc_id and each task streams its range
    into a file of its own name; the manifest, written by Spark, names the
    files of the attempts that succeeded, so a retried task leaves no trace in
    the result. ``bits`` is 16 or 32; by default 16 if the tokenizer's largest
    id and ``end_id`` fit, else 32. An id that does not fit is an error.
    ``path`` is a folder every executor can write (default: a new
    one under spark.checkpoint.dir).

    Edge cases: a null or blank text is the end id alone; null doc_ids come
    first; rows of one doc_id are ordered by text; an empty table gives no
    file; other columns are not read."""
    folder = path or fresh_path(docs.sparkSession, "token-files")
    parts = shuffle_width(docs)
    kind = "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=kind).tobytes()
        out = name = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
                _make_folder(folder)
                out = TokenFileWriter(name, length, bits or id_bits(max(enc.largest, end_id)))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                out.add(doc_id, np.frombuffer(ids + end, dtype=kind))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [out.n_docs],
                                              "n_ids": [out.n_ids]})

    files = materialise(
        doc_texts(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "part bigint, path string, n_docs bigint, n_ids bigint"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def _make_folder(folder: str) -> None:
    filesystem, at = _file_system(folder)
    filesystem.create_dir(at, recursive=True)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files:
    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the
    unsigned CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                f = TokenFile(path)
                for part in f.index.to_batches():
                    start = part.column("start").to_numpy()
                    n = part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(f.ids(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(start + base), part.column("n_tokens"),
                         pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    m = manifest.select("path", "base")
    return m.repartition(max(1, shuffle_width(m)), "path") \
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
