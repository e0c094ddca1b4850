"""Length-delimited binary records with masked checksums and a separate offset index (operator 7).

A file is a run of frames: payload length (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the payload
(u32), all little-endian. A checksum is CRC-32, rotated right by 15 bits and increased by a constant, so that a checksum stored
inside checked data does not look like one. A payload holds the id width in bytes (u8), then the ids as unsigned 16-bit numbers
where all fit, else 32-bit. Beside it, `.idx` has one entry per record: key (i64), its validity (u8), offset of the frame (u64),
number of ids (u64); shuffled reads seek by it.

Writing: rows are dealt by ranges of (key, digest of the text), so that one key on very many rows is split, and sorted within a
task. Every attempt writes files under its own name; only those whose rows reach the manifest count, so a lost executor or a
second attempt leaves no half-written file in the result. Nothing passes through the driver but the manifest's row count.

Rows: a null text is an empty one; a null key sorts first and comes back as null; equal keys keep all their rows, in the order of
their texts. An empty table gives no files and no rows. Extra columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import workspace, written
from tidemark.llm.tokens import library_encoder, slices

#: Fixed value of the masked checksum.
MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("key", "<i8"), ("valid", "u1"), ("offset", "<u8"), ("n_ids", "<u8")])
MANIFEST = "part int, path string, n_records long, n_ids long, n_bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(ids: np.ndarray) -> bytes:
    """One record."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = bytes([width]) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked_crc(head)), body, struct.pack("<I", masked_crc(body))))


def read_frame(stream) -> np.ndarray | None:
    """Ids of the next record, None at the end; damage raises."""
    head = stream.read(12)
    if not head:
        return None
    (size, check) = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != check:
        raise ValueError("length checksum does not match")
    body = stream.read(size + 4)
    if len(body) != size + 4 or masked_crc(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("payload checksum does not match")
    return np.frombuffer(body[1:-4], f"<u{body[0]}").astype("<u4")


def filesystem(uri: str):
    """Any store that pyarrow can open, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], folder: str, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encodes and writes in ascending order of the key; returns the manifest, one row per file. `encoder` is called in the task."""
    spark = docs.sparkSession
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select(key).rdd.getNumPartitions())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(n, "key", tie).sortWithinPartitions(F.col("key"), tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(), TaskContext.get().partitionId()
        store, root = filesystem(folder)
        path, entries, at, total, out = f"{root}/part-{part:06d}-{uuid.uuid4().hex}", [], 0, 0, None
        for b in slices(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{path}.rec")
            for k, ids in zip(b.column("key").to_pylist(), encode(b.column("text").to_pylist())):
                data = frame(ids)
                out.write(data)
                entries.append((k or 0, k is not None, at, len(ids)))
                at += len(data)
                total += len(ids)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}.idx") as index:
                index.write(np.array(entries, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_records": [len(entries)], "n_ids": [total], "n_bytes": [at]})

    return written(rows.mapInArrow(run, MANIFEST), "records-manifest")


def read_records(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, from the files: key, start (ids of all records before it), n_ids, ids_crc32 and the ids as u32 bytes."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with store.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as f:
                    for at in range(0, len(index), 256):
                        keys, starts, sizes, crcs, raw = [], [], [], [], []
                        for e in index[at : at + 256]:
                            ids = read_frame(f)
                            if ids is None or len(ids) != e["n_ids"]:
                                raise ValueError(f"{path}: index and records differ")
                            data = ids.tobytes()
                            keys.append(int(e["key"]) if e["valid"] else None)
                            starts.append(start)
                            sizes.append(len(ids))
                            crcs.append(zlib.crc32(data))
                            raw.append(data)
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "n_ids": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "ids": pa.array(raw, pa.binary())})

    return based.repartition(max(1, manifest.count())).mapInArrow(run, "key long, start long, n_ids long, ids_crc32 long, ids binary")


def read_record(folder: str, path: str, n: int) -> np.ndarray:
    """The n-th record of a file, by one seek: what a shuffled reader does."""
    store, _ = filesystem(folder)
    with store.open_input_file(f"{path}.idx") as f:
        f.seek(n * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with store.open_input_file(f"{path}.rec") as f:
        f.seek(int(entry["offset"]))
        return read_frame(f)


def with_end(path: str, end: int, spaced: bool) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Library tokenizer at `path`, and the id `end` behind each text."""

    def make():
        batch, tail = library_encoder(path, spaced).batch, np.array([end], "<u4").tobytes()
        return lambda texts: [np.frombuffer(x + tail, "<u4") for x in batch(texts)]

    return make


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Documents written to record files and read back."""
    folder = workspace(docs.sparkSession, "records")
    manifest = write_records(docs, with_end(tokenizer, end, spaced=False), folder)
    return read_records(docs.sparkSession, manifest, folder).drop("ids").withColumnsRenamed({"key": "doc_id", "n_ids": "n_tokens"})
