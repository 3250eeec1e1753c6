"""Stored chunks of texts, and compact blobs that chunks and buckets exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import kernels
from pairloom.session import materialize


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Numbers as their differences: ascending keys, or values that often repeat."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def spare_bits(buckets: int) -> int:
    """Low bits of a hash to leave out so that 44 bits tell the keys of a bucket apart."""
    return max(0, 64 - 44 - int(np.ceil(np.log2(max(buckets, 1)))))


def without_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(bits) << np.uint64(bits)


def bucket_ends(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of values ends among the sorted keys."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    inner = np.searchsorted(keys, np.array(edges, np.uint64), "left")
    return np.concatenate([inner, [len(keys)]])


def text_chunks(docs: DataFrame, limit: int, mark: Column) -> DataFrame:
    """Stored rows of texts, at most ``limit`` bytes each or one longer text.

    Columns: chunk, doc_ids, marks (one boolean a text), sizes, data (packed bytes), n_bytes.
    Chunk numbers hold only for this stored table, which is why it is stored.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in kernels.slices(batch, "text", limit):
                data, at = kernels.text_bytes(piece.column("text"))
                row = {
                    "chunk": (part << 32) + made,
                    "doc_ids": piece.column("doc_id").to_pylist(),
                    "marks": piece.column("mark").to_pylist(),
                    "sizes": np.diff(at).tolist(),
                    "data": zstandard.ZstdCompressor(level=3).compress(data.tobytes()),
                    "n_bytes": len(data),
                }
                made += 1
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema(
        [
            ("chunk", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("marks", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int64())),
            ("data", pa.binary()),
            ("n_bytes", pa.int64()),
        ]
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    return materialize(
        rows.mapInArrow(
            packed,
            "chunk long, doc_ids array<long>, marks array<boolean>, sizes array<long>, "
            "data binary, n_bytes long",
        ),
        "chunks",
    )


def chunk_bytes(data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk's texts in a row and the offsets of the texts."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return raw, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


def bucket_count(chunks: DataFrame, bytes_a_bucket: int) -> int:
    n_bytes = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-n_bytes // bytes_a_bucket))


def by_chunk(answers: DataFrame, columns: list[str], chunks_a_task: int | None = None) -> DataFrame:
    """chunk, answers: the answers of all buckets to a chunk, no more than its own questions.

    With ``chunks_a_task`` the number of tasks follows the number of chunks, not the setting.
    """
    own = answers.where("chunk IS NOT NULL")
    if chunks_a_task:
        chunks = own.agg(F.approx_count_distinct("chunk").alias("n")).first()["n"]
        own = own.repartition(max(1, -(-chunks // chunks_a_task)), "chunk")
    return own.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", *columns)).alias("answers")
    )
