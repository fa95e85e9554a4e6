"""Token-id files of bit or byte planes.

A segment holds whole documents. Its ids lie in blocks of a fixed number; each block is transposed into planes (the
n-th bit, or byte, of every id together), and each plane is a zstandard frame of its own. The chunk index at the end
has the place and size of every plane, the document index the id and length of every document, so a reader can
fetch one document by decompressing only the blocks that it touches.

Layout: magic, planes, footer (zstd: document ids, null flags, lengths, plane sizes), then a trailer of fixed size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import encode_texts, library
from quern.session import written

MAGIC = b"QPL1"
TRAILER = struct.Struct("<4sBIQQQ")  # magic, planes a block, ids a block, ids, documents, start of the footer
BLOCK = 65_536
#: A segment is closed when it has so many ids; one longer document makes a longer segment.
SEGMENT = 2_000_000


def to_planes(ids: np.ndarray, planes: str) -> np.ndarray:
    """uint32 ids -> one row of bytes for each plane: 4 byte planes, or 32 bit planes of n/8 bytes rounded up."""
    grid = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return np.ascontiguousarray(grid.T)
    bits = np.unpackbits(grid, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def from_planes(rows: np.ndarray, n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class SegmentWriter:
    """Collects documents' ids; `finish` gives the bytes of the segment."""

    def __init__(self, planes: str = "byte", block: int = BLOCK, level: int = 3):
        if planes not in ("bit", "byte"):
            raise ValueError("planes: bit or byte")
        self.planes, self.block = planes, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.ids: list[bytes] = []
        self.docs: list[int | None] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.docs.append(doc_id)
        self.ids.append(raw)
        self.n_ids += len(raw) // 4

    def finish(self) -> bytes:
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        out, sizes = [MAGIC], []
        for at in range(0, len(ids), self.block):
            for row in to_planes(ids[at : at + self.block], self.planes):
                out.append(self.zstd.compress(row.tobytes()))
                sizes.append(len(out[-1]))
        lengths = np.fromiter((len(x) // 4 for x in self.ids), "<u8", len(self.ids))
        ids_of = np.fromiter((d or 0 for d in self.docs), "<i8", len(self.docs))
        nulls = np.fromiter((d is None for d in self.docs), np.uint8, len(self.docs))
        footer_at = sum(map(len, out))
        out.append(self.zstd.compress(ids_of.tobytes() + nulls.tobytes() + lengths.tobytes() + np.array(sizes, "<u4").tobytes()))
        out.append(TRAILER.pack(MAGIC, 32 if self.planes == "bit" else 4, self.block, len(ids), len(self.docs), footer_at))
        return b"".join(out)


class SegmentReader:
    def __init__(self, data: bytes):
        self.data = data
        magic, n_planes, self.block, self.n_ids, n_docs, at = TRAILER.unpack(data[-TRAILER.size :])
        if magic != MAGIC or data[:4] != MAGIC:
            raise ValueError("not a plane segment")
        self.n_planes, self.planes = n_planes, "bit" if n_planes == 32 else "byte"
        self.zstd = zstandard.ZstdDecompressor()
        footer = self.zstd.decompress(data[at : -TRAILER.size])
        ids, nulls = np.frombuffer(footer, "<i8", n_docs), np.frombuffer(footer, np.uint8, n_docs, 8 * n_docs)
        self.docs = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        lengths = np.frombuffer(footer, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.frombuffer(footer, "<u4", -1, 17 * n_docs).astype(np.int64)
        #: The chunk index: where the planes of each block begin, and the end.
        self.index = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)])

    def block_ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        at = self.index[k * self.n_planes : (k + 1) * self.n_planes + 1].tolist()
        rows = [np.frombuffer(self.zstd.decompress(self.data[a:b]), np.uint8) for a, b in zip(at, at[1:], strict=False)]
        return from_planes(np.stack(rows), n, self.planes)

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its blocks are read."""
        a, b = int(self.begin[k]), int(self.begin[k + 1])
        if a == b:
            return np.empty(0, "<u4")
        first = a // self.block
        got = np.concatenate([self.block_ids(j) for j in range(first, (b - 1) // self.block + 1)])
        return got[a - first * self.block : b - first * self.block]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the segment, ids) of all documents in order; each block is read once."""
        have, base = np.empty(0, "<u4"), 0
        for k, doc in enumerate(self.docs):
            a, b = int(self.begin[k]), int(self.begin[k + 1])
            while base + len(have) < b:
                more = self.block_ids((base + len(have)) // self.block)
                have, base = np.concatenate([have[a - base :], more]), a
            yield doc, a, have[a - base : b - base]


def save(path: str, docs: Iterable[tuple[int | None, np.ndarray]], **options) -> None:
    """Write one local segment file."""
    w = SegmentWriter(**options)
    for d, ids in docs:
        w.add(d, np.asarray(ids, "<u4").tobytes())
    with open(path, "wb") as f:
        f.write(w.finish())


def load(path: str) -> SegmentReader:
    with open(path, "rb") as f:
        return SegmentReader(f.read())


def write_segments(df: DataFrame, tokenizer: str, end_id: int | None = 0, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write their ids as segments into the shared folder; returns the written table.

    One row a segment: shard, local_start (ids of the shard before it), n_ids, payload. Shards and their segments are
    in ascending order of id, nulls first, equal ids by their texts. The range shuffle also splits rows of one id.
    Null and empty texts have only the end id. Spark's writer commits, so a lost executor leaves no half file.
    """
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = library(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        shard, start, w = TaskContext.get().partitionId(), 0, SegmentWriter(planes)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "local_start": pa.array([start], pa.int64()), "n_ids": pa.array([w.n_ids], pa.int64()), "payload": pa.array([w.finish()], pa.binary())})

        for b in batches:
            for doc, raw in zip(b.column("id").to_pylist(), encode_texts(b.column("text").to_pylist(), split, cache), strict=True):
                w.add(doc, raw + end)
                if w.n_ids >= SEGMENT:
                    yield row()
                    start, w = start + w.n_ids, SegmentWriter(planes)
        if w.docs:
            yield row()

    ranged = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return written(ranged.mapInArrow(run, "shard int, local_start long, n_ids long, payload binary"), "planes")


def read_segments(segments: DataFrame) -> DataFrame:
    """One row a document, from the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the totals of shards meet in one task, a row for each partition of the writer.
    """
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column("base").to_pylist(), b.column("payload"), strict=True):
                rows = [(d, base + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in SegmentReader(payload.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(starts, "shard").select((F.col("shard_start") + F.col("local_start")).alias("base"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_planes(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document written as byte planes in ascending doc_id order, and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_segments(write_segments(docs, public_tokenizers.path("byte_bpe_50k.json")))
