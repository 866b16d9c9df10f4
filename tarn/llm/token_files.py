"""Token ids in Arrow files of equal-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.batches import slices
from tarn.llm.tokens import default_path, encoder
from tarn.session import durable, scratch_path

SEQUENCE = 1024
#: Sequences in a record batch, and documents in a batch of the document index.
BATCH = 256
DOC_BATCH = 8192

#: Bytes of text in a range and so in a pair of files; ranges smaller than the second are not
#: made for the sake of more tasks.
RANGE_BYTES, LEAST_BYTES = 256 << 20, 8 << 20

MANIFEST = "part long, tokens_file string, docs_file string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def token_schema(id_type: np.dtype) -> pa.Schema:
    ids = pa.list_(pa.from_numpy_dtype(id_type), SEQUENCE)
    return pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in fixed-size-list batches."""

    def __init__(self, sink: pa.NativeFile, id_type: np.dtype):
        self.schema = token_schema(id_type)
        self.id_type = id_type
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.id_type))
        self.n_held += len(ids)
        full = self.n_held // (SEQUENCE * BATCH) * SEQUENCE * BATCH
        if full:
            flat = np.concatenate(self.held)
            for start in range(0, full, SEQUENCE * BATCH):
                self._write(flat[start : start + SEQUENCE * BATCH])
            self.held = [flat[full:]]
            self.n_held -= full

    def _write(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // SEQUENCE)
        mask = np.arange(rows * SEQUENCE) < len(flat)
        padded = np.zeros(rows * SEQUENCE, self.id_type)
        padded[: len(flat)] = flat
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(padded), SEQUENCE),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        self.writer.close()


class TokenFile:
    """Random access to the sequences of one file, without copying where it is mapped."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self._at = -1
        self._batch: pa.RecordBatch | None = None

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._batch = i, self.reader.get_batch(i)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``; the ids are a view of the file."""
        batch, row = self.batch(i // BATCH), i % BATCH
        ids = batch.column("ids").flatten().to_numpy()[row * SEQUENCE : (row + 1) * SEQUENCE]
        return ids, batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file's stream; a view, unless they span batches."""
        size = SEQUENCE * BATCH
        parts = []
        for i in range(start // size, (start + n - 1) // size + 1 if n else 0):
            flat = self.batch(i).column("ids").flatten().to_numpy()
            parts.append(flat[max(start - i * size, 0) : start + n - i * size])
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint16), *parts])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text), in ascending doc_id order, below ``path``.

    Rows are dealt out by ranges of the id, as many as the size of the texts asks for; each task writes the sequences of its range and
    an index of its documents. Files are named by the attempt, and the returned manifest
    (``MANIFEST``, one row for each range that holds rows, in order of ``part``) lists those
    of the attempts that succeeded, so lost executors leave no wrong file in it. ``path`` is
    a URI in a store all machines share.

    Null and empty texts are one id, 0. Null ids come first; rows with the same id follow
    each other in the order of a hash of their text. An empty table gives no files.
    """
    model = tokenizer or default_path()
    base = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = None
        n_docs = n_tokens = 0
        for rows, data, at in slices(batches):
            if writer is None:
                coder = encoder(model)
                fs, root = pa.fs.FileSystem.from_uri(base)
                fs.create_dir(root, recursive=True)
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
                sinks = [fs.open_output_stream(f"{root}/{name}.{kind}.arrow") for kind in ("tokens", "docs")]
                writer = SequenceWriter(sinks[0], coder.id_type)
                index = pa.ipc.new_file(sinks[1], DOCS)
            ids, offsets = coder.encode_bytes(data, at)
            writer.add(ids)
            starts = pa.array(offsets[:-1] + n_tokens, pa.int64())
            sizes = pa.array(np.diff(offsets), pa.int64())
            index.write_table(
                pa.Table.from_arrays([rows.column("doc_id").cast(pa.int64()), starts, sizes], schema=DOCS), DOC_BATCH
            )
            n_docs += rows.num_rows
            n_tokens += len(ids)
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            files = [f"{base}/{name}.{kind}.arrow" for kind in ("tokens", "docs")]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [task.partitionId()],
                    "tokens_file": [files[0]],
                    "docs_file": [files[1]],
                    "n_docs": [n_docs],
                    "n_tokens": [n_tokens],
                }
            )

    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-size // RANGE_BYTES), min(usual, -(-size // LEAST_BYTES)), 1)
    rows = rows.repartitionByRange(ranges, "doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return durable(rows.mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files in ``manifest``.

    ``start`` counts the ids of all documents before it over all files. Files are read
    through their index a batch at a time.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens_file"])
                fs, path = pa.fs.FileSystem.from_uri(row["docs_file"])
                index = pa.ipc.open_file(fs.open_input_file(path))
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    spans = zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True)
                    crc = [zlib.crc32(tokens.tokens(a, n).astype("<u4").tobytes()) for a, n in spans]
                    start = pa.array(docs.column("start").to_numpy() + row["before"])
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # By number: the few bytes of a manifest would otherwise be one task's work.
    n_files = max(1, manifest.count())
    files = placed.repartition(n_files, "part").select("tokens_file", "docs_file", "before")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_path(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return scratch_path(spark, "tokens")
