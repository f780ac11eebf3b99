"""Token ids in Arrow files of equal-length sequences.

A shard is an Arrow IPC file whose record batches hold two fixed-size lists, ``ids`` (unsigned,
16-bit where the vocabulary allows it, else 32-bit) and ``mask`` (bits; 1 marks a real token), each
``SEQUENCE`` long, uncompressed. A memory-mapped reader gets any sequence or mask without a copy: the
values of a list lie at ``sequence * SEQUENCE`` in one buffer. Documents follow each other in ascending doc_id order, each
ending with the end id; only the last sequence of a shard is padded. A second Arrow file beside it
lists the shard's documents (doc_id, start in the shard, n_tokens).

Shards are range partitions by doc_id, so the texts are shuffled once; there are as many as the number of documents needs, a doc_id with very many rows is dealt over
several, and a file of ``SHARD_TOKENS`` tokens is followed by another, so neither a task nor a file grows with the table. A task writes
files under names of its own attempt and returns them; files of lost attempts are never listed. The list of files stays a table, and a
running sum over it says where each file's ids begin. Paths go through ``pyarrow.fs``, which knows the same stores as the shared folder's URI.

Results for odd input: a null text is empty and holds just the end id; null doc_ids come first;
rows with equal doc_ids follow each other by text; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import TEXT_BYTES, new_folder, short_batches, text_chunks, written
from .tokens import MORE_PIECES, encoder, tokenizer_path

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 512
#: Documents that a shard holds at most, about; beyond, there are more shards.
SHARD_DOCS = 20_000
#: Tokens of a file, about: beyond, a shard goes on in another.
SHARD_TOKENS = 1 << 26
#: Characters by which texts of one doc_id are dealt over shards.
BEGINNING = 64
SHARD_SCHEMA = "shard int, part int, ids_path string, docs_path string, n_docs long, n_tokens long"


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path) if not isinstance(store, fs.LocalFileSystem) else pa.memory_map(path, "r")


class ShardWriter:
    """Writes one shard; holds at most a record batch of sequences in memory."""

    def __init__(self, uri: str, sequence: int = SEQUENCE, vocabulary: int = 1 << 32):
        self.uri, self.sequence = uri, sequence
        self.kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        kinds = [("ids", pa.list_(pa.from_numpy_dtype(self.kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))]
        self.schema = pa.schema(kinds, metadata={"sequence": str(sequence)})
        self.sink = _open(f"{uri}.arrow", "w")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.docs_sink = _open(f"{uri}.docs.arrow", "w")
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs_out = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.held: list[bytes] = []
        self.held_tokens, self.n_tokens, self.n_docs = 0, 0, 0

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        starts = self.n_tokens + np.cumsum(counts) - counts
        self.docs_out.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.docs_schema))
        total = int(counts.sum())
        self.held += ids
        self.held_tokens += total
        self.n_tokens += total
        self.n_docs += len(ids)
        if self.held_tokens >= self.sequence * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        """Write what makes full record batches; at the end also the rest, padded to a full sequence."""
        flat, step = np.frombuffer(b"".join(self.held), "<u4"), self.sequence * BATCH
        full = len(flat) // step * step
        for at in range(0, full, step):
            self._write(flat[at : at + step], step)
        rest = flat[full:]
        self.held, self.held_tokens = [rest.tobytes()] if len(rest) else [], len(rest)
        if last and len(rest):
            self._write(np.pad(rest, (0, -len(rest) % self.sequence)), len(rest))

    def _write(self, ids: np.ndarray, real: int) -> None:
        values = pa.array(ids.astype(self.kind, copy=False)), pa.array(np.arange(len(ids)) < real)
        arrays = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in values]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.sink, self.docs_out, self.docs_sink):
            x.close()


def read_sequence(ids_path: str, index: int) -> tuple[pa.Array, pa.Array]:
    """Sequence ``index`` of a shard and its mask, as Arrow arrays over the mapped file's own bytes."""
    reader = pa.ipc.open_file(_open(ids_path, "r"))
    batch = reader.get_batch(index // BATCH)
    n = batch.schema.field("ids").type.list_size
    at = index % BATCH * n
    return tuple(batch.column(c).values.slice(at, n) for c in ("ids", "mask"))


def read_documents(ids_path: str, docs_path: str) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """The documents of a shard as their files hold them: doc_ids, starts in the shard and ids, in batches."""
    reader = pa.ipc.open_file(_open(ids_path, "r"))
    docs = pa.ipc.open_file(_open(docs_path, "r"))
    kind = reader.schema.field("ids").type.value_type.to_pandas_dtype()
    held, held_from, k = np.zeros(0, kind), 0, 0
    for i in range(docs.num_record_batches):
        b = docs.get_batch(i)
        starts, counts = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
        need = int(starts[-1] + counts[-1])
        parts = [held[int(starts[0]) - held_from :]]
        held_from, have = int(starts[0]), len(parts[0])
        while held_from + have < need:
            batch = reader.get_batch(k)
            parts.append(batch.column("ids").values.to_numpy(zero_copy_only=True)[: batch.column("mask").values.true_count])
            have += len(parts[-1])
            k += 1
        held = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield b.column("doc_id").to_pylist(), starts, [held[s - held_from : s - held_from + n] for s, n in zip(starts, counts, strict=True)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, sequence: int = SEQUENCE, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``; one row per file: ``SHARD_SCHEMA``.

    A shard is a range partition; (``shard``, ``part``) ascends with doc_id.
    """
    shards = max(1, -(-docs.select("doc_id").count() // shard_docs))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        enc, writer, part, shard = encoder(tokenizer, pieces=MORE_PIECES), None, 0, TaskContext.get().partitionId()

        def finished(w: ShardWriter) -> pa.RecordBatch:
            w.close()
            row = [[shard], [part], [f"{w.uri}.arrow"], [f"{w.uri}.docs.arrow"], [w.n_docs], [w.n_tokens]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for b in text_chunks(batches, size=min(TEXT_BYTES, 4 * shard_tokens)):
            if writer is None:
                writer = ShardWriter(f"{folder}/{shard:08d}-{part:04d}-{uuid.uuid4().hex}", sequence, len(enc.id_bytes))
            writer.add(b.column("doc_id").to_pylist(), [x + end for x in enc.encode(b.column("text"))])
            if writer.n_tokens >= shard_tokens:
                yield finished(writer)
                writer, part = None, part + 1
        if writer:
            yield finished(writer)

    # Rows of one doc_id go on from shard to shard by how their texts begin.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.repartitionByRange(shards, "doc_id", F.substring("text", 1, BEGINNING))
    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, read from the files listed in ``shards``."""
    before = F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    listed = shards.select("ids_path", "docs_path", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches):
        for b in batches:
            for ids_path, docs_path, base in zip(*[b.column(c).to_pylist() for c in ("ids_path", "docs_path", "base")], strict=True):
                for doc_ids, starts, ids in read_documents(ids_path, docs_path):
                    cols = [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + base),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with short_batches(spark):
        shards = written(write_token_files(docs, f"{folder}/ids", tokenizer_path("byte_bpe_50k.json")), "shards")
    return read_token_files(shards)
