"""Token-id files: the ids of many documents in one array, their boundaries Elias-Fano encoded.

A file holds consecutive documents. The document ends, a rising sequence of n numbers up to the id count u, are split into low bits, which are
packed, and high bits, which become one unary bit vector; with the place of every 64th one bit kept, the i-th end is found by a short scan.
That is 2 + log2(u / n) bits and half a byte of select samples per document, and no table of 64-bit offsets.

The texts are dealt out by ranges of doc_id and each task encodes its range, so neither the ids nor an order of all rows ever meet in one place.
Files are the rows of a Parquet table (part, seq, doc_ids, n_docs, n_ids, content), so they live wherever Spark can write.

Defined results
* A null or empty text is a document of the end id alone; texts are read whole, at any length, and one long document may be a file of its own.
* Rows are ordered by doc_id, nulls first; rows with the same doc_id follow each other in an order that is fixed once written.
  Repeated rows are documents of their own. An empty table gives no files and no rows.
* Only the id and text columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotspark.llm.tokens import encoder
from plotspark.session import scratch_path

MAGIC = b"PSTOKEN1"
HEADER = "<8sBBxxIQII"  # magic, bytes of an id, low bits, documents, ids, bytes of low bits, bytes of high bits
SELECT_EVERY = 64
FILE_IDS = 4 << 20
FILE_SCHEMA = "part int, seq int, doc_ids array<bigint>, n_docs bigint, n_ids bigint, content binary"
FILE_COLUMNS = ["part", "seq", "doc_ids", "n_docs", "n_ids", "content"]
ROW_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
ROW_COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]


class Boundaries:
    """A rising sequence of ends in Elias-Fano form."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, ends: np.ndarray) -> Boundaries:
        ends = ends.astype(np.uint64)
        count, top = len(ends), int(ends[-1]) if len(ends) else 0
        low_bits = max(0, int(math.floor(math.log2(top / count)))) if count and top else 0
        bits = (ends[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1
        ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        high = np.zeros(int(ones[-1]) + 1 if count else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(count, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th end, by the nearest sample and a scan of at most 64 ones."""
        at, left = int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        seen = -int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: at % 8].sum())
        while True:
            word = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
            if seen + len(word) > left:
                place = byte * 8 + int(word[left - seen])
                break
            seen += len(word)
            byte += 1
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_bits]
        return ((place - i) << self.low_bits) + sum(int(b) << k for k, b in enumerate(bits))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        bits = np.unpackbits(self.low, bitorder="little", count=self.count * self.low_bits).reshape(self.count, self.low_bits).astype(np.int64)
        return ((ones - np.arange(self.count)) << self.low_bits) + (bits << np.arange(self.low_bits)).sum(axis=1)


def write_file(documents: list[bytes], id_bytes: int) -> bytes:
    """One file of packed documents."""
    ends = np.cumsum([len(d) // id_bytes for d in documents], dtype=np.int64)
    index = Boundaries.of(ends)
    low, high, samples = index.low.tobytes(), index.high.tobytes(), index.samples.tobytes()
    head = struct.pack(HEADER, MAGIC, id_bytes, index.low_bits, len(documents), int(ends[-1]) if len(ends) else 0, len(low), len(high))
    return b"".join([head, low, high, samples, *documents])


class TokenFile:
    """A file's boundaries and ids, read in place."""

    def __init__(self, content: bytes):
        magic, id_bytes, low_bits, self.n_docs, self.n_ids, n_low, n_high = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)
        take = lambda kind, start, count: np.frombuffer(content, dtype=kind, count=count, offset=start)
        low, high = take(np.uint8, at, n_low), take(np.uint8, at + n_low, n_high)
        at += n_low + n_high
        samples = -(-self.n_docs // SELECT_EVERY)
        self.ends = Boundaries(self.n_docs, low_bits, low, high, take("<u4", at, samples))
        self.ids = take(f"<u{id_bytes}", at + 4 * samples, self.n_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write the files of ``docs`` in ascending doc_id order as a Parquet table at ``path``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end, width = np.array([end_id], dtype=own.dtype).tobytes(), own.dtype.itemsize
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        documents: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal seq, names, documents, size
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([len(names)]), pa.array([size // width]), pa.array([write_file(documents, width)], pa.binary())]
            seq, names, documents, size = seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays(row, names=FILE_COLUMNS)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                for name, ids in zip(few.column(0).to_pylist(), own.encode(few.column(1).to_pylist()), strict=True):
                    names.append(name)
                    documents.append(ids + end)
                    size += len(ids) + width
                    if size >= file_ids * width:
                        yield full()
        if names:
            yield full()

    rows.mapInArrow(files, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as 32-bit numbers) of every document of the files."""
    files = spark.read.parquet(path)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                names, first, content = (batch.column(i)[at] for i in range(3))
                file = TokenFile(content.as_buffer())
                ends = file.ends.all()
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(begins + first.as_py()), pa.array(ends - begins), pa.array(sums, pa.int64())], names=ROW_COLUMNS)

    placed = files.select("part", "seq", "doc_ids", "content").join(starts, ["part", "seq"])
    return placed.select("doc_ids", "first", "content").mapInArrow(documents, ROW_SCHEMA)


def token_file_rows(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files of ``docs`` to a new folder below the shared checkpoint folder, and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
