"""Token-ID / binary output (7): length-delimited binary records.

A shard is a file of records, one a document, each framed as

    length of the payload (8 bytes), its masked CRC-32 (4), payload, masked CRC-32 of the payload (4)

after a header that names the width of an id. Beside it stands an index of
(doc_id, offset, number of ids) for shuffled reads. Shards follow each other in
ascending doc_id order. A task writes under a name of its own attempt, and the
manifest lists the files of the attempts that ended well, so retries and lost
executors leave no half-written shard in it.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

MAGIC, INDEX_MAGIC = b"LOOMREC1", b"LOOMIDX1"
_MASK = 0xA282EAD8
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
MANIFEST = "shard int, path string, index_path string, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    """CRC-32 rotated and shifted by a constant, so that data which hold their own checksums don't check as themselves."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload of f, or None at its end; ValueError for what is cut or damaged."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = f.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


def _open(path: str, write: bool = False):
    """A stream of a file in any store that Arrow knows; executors have no Hadoop client in Python."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if write:
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


def read_header(f) -> np.dtype:
    head = f.read(16)
    if len(head) < 16 or head[:8] != MAGIC or masked(head[:12]) != struct.unpack("<I", head[12:])[0]:
        raise ValueError("not a record file")
    return np.dtype(f"<u{struct.unpack('<I', head[8:12])[0]}")


def read_index(path: str) -> np.ndarray:
    with _open(path) as f:
        data = f.read()
    if data[:8] != INDEX_MAGIC or masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged index")
    return np.frombuffer(data[8:-4], _ENTRY)


def shuffled_read(path: str, index_path: str, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a shard in a random order, one seek a record."""
    index = read_index(index_path)
    order = list(range(len(index)))
    random.Random(seed).shuffle(order)
    with _open(path) as f:
        width = read_header(f)
        for n in order:
            f.seek(int(index["offset"][n]))
            yield int(index["doc_id"][n]), np.frombuffer(read_frame(f), width)


def write_token_records(docs: DataFrame, where: str, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending doc_id order to the folder `where`, which executors and driver share.

    Returns the manifest, a table with a row a shard. Texts that are null or
    empty give a record of the end id alone; null doc_ids stand last; rows of
    one doc_id stand together, in the order of a hash of their texts.
    """
    spark = docs.sparkSession
    path = vocabulary or bpe.vocabulary_path()
    n = common.partitions(spark)
    ordered = common.keyed(docs).repartitionByRange(n, "_id", "_key").sortWithinPartitions("_id", "_key")
    common.ship(spark)

    def write(batches):
        context = TaskContext.get()
        shard = context.partitionId()
        name = f"{where.rstrip('/')}/shard-{shard:05d}-{context.taskAttemptId()}"
        out, entries, tokens = None, [], 0
        c = bpe.codec(path)
        width = np.dtype("<u2" if len(c.lengths) <= 1 << 16 and end_id < 1 << 16 else "<u4")
        try:
            for batch in batches:
                for part in common.slices(batch, "_text"):
                    if out is None and part.num_rows:
                        out = _open(f"{name}.rec", True)
                        head = MAGIC + struct.pack("<I", width.itemsize)
                        out.write(head + struct.pack("<I", masked(head)))
                        at = 16
                    ids = part.column("_id").to_pylist()
                    for doc_id, own in zip(ids, c.arrays(part.column("_text").to_pylist()), strict=True):
                        own = np.append(own, np.uint32(end_id)).astype(width)
                        record = frame(own.tobytes())
                        out.write(record)
                        entries.append((doc_id, at, len(own)))
                        at += len(record)
                        tokens += len(own)
        finally:
            if out is not None:
                out.close()
            common.tidy()
        if out is not None:
            with _open(f"{name}.idx", True) as f:
                data = INDEX_MAGIC + np.array(entries, _ENTRY).tobytes()
                f.write(data + struct.pack("<I", masked(data)))
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{name}.rec"]), pa.array([f"{name}.idx"]), pa.array([len(entries)], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "path", "index_path", "n_docs", "n_tokens"])

    return common.written(ordered.select("_id", "_text").mapInArrow(write, MANIFEST))


def read_token_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian), shard, offset; from the files alone."""
    spark = manifest.sparkSession
    common.ship(spark)
    # the manifest has a row a shard, so one task orders it
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", "index_path", before.alias("start")).repartition(common.partitions(spark), "shard")

    def read(batches):
        for batch in batches:
            for x in batch.to_pylist():
                start, out = x["start"], []
                index = read_index(x["index_path"])
                with _open(x["path"]) as f:
                    width = read_header(f)
                    for entry in index:
                        if f.tell() != entry["offset"]:
                            raise ValueError("index and records differ")
                        ids = np.frombuffer(read_frame(f), width)
                        out.append((int(entry["doc_id"]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), x["shard"], int(entry["offset"])))
                        start += len(ids)
                        if len(out) == 4096:
                            yield _rows(out)
                            out = []
                    if f.read(1):
                        raise ValueError("records beyond the index")
                if out:
                    yield _rows(out)

    rows = placed.mapInArrow(read, "_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long")
    return rows.select(common.shown_id(), "start", "n_tokens", "ids_crc32", "shard", "offset")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_records(common.documents(spark, sf_dir), common.shared_dir(spark))
    return read_token_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
