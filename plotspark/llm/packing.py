"""Packing of token documents into windows by non-negative least squares over the length histogram.

Every document is cut into full windows and a rest. The rests' lengths are counted; ``window_plan.layout`` gives every rank of every length its
sequence and place: repeat counts of shallow combinations by non-negative least squares, what they leave by best fit, and only what would fill
no window is laid end to end and cut where a window is full. The histogram has at most ``window`` rows, and the layout depends on its lengths and not
on how many documents there are; documents find their place by their rank among the rests of their length.

Defined results
* A null or empty text is a document of the end id alone. Texts are encoded whole, at any length.
* Every id lies in exactly one piece; a sequence holds at most ``window`` ids and its pieces' offsets have no gap.
* Repeated rows, repeated and null doc_ids are documents of their own; which of equal rows gets which place makes no difference.
* An empty table gives no piece. Only the id and text columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotspark.llm.running import running_total
from plotspark.llm.tokens import encoder, forget
from plotspark.llm.window_plan import DEPTH, Layout, combinations, layout, least_squares, plan
from plotspark.session import scratch_path

WINDOW = 4096
UNIT = 8
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 64
TOKEN_SCHEMA = "doc_id bigint, doc_tokens bigint, full_crc32 array<bigint>, rest_crc32 bigint, ids binary"
TOKEN_COLUMNS = ["doc_id", "doc_tokens", "full_crc32", "rest_crc32", "ids"]
RANK_BITS = 40
PIECE = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> None:
    """Token ids of every document, checksums of its full windows and of its rest, and a row number, as Parquet at ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                packed = [ids + end for ids in own.encode(few.column(1).to_pylist())]
                counts, full, rest = [], [], []
                for ids in packed:
                    wide = np.frombuffer(ids, dtype=own.dtype).astype("<u4")
                    cut = len(wide) // window * window
                    counts.append(len(wide))
                    full.append([zlib.crc32(wide[a : a + window].tobytes()) for a in range(0, cut, window)])
                    rest.append(zlib.crc32(wide[cut:].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(counts, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int64()), pa.array(packed, pa.binary())], names=TOKEN_COLUMNS,
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, TOKEN_SCHEMA)
    rows.withColumn("rid", F.monotonically_increasing_id()).write.parquet(path)


def _crc32_of(ids: str, start: str, length: str, id_bytes: int) -> Column:
    """Checksum of a run of packed ids as 32-bit numbers."""

    @F.pandas_udf("bigint")
    def run(packed: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        forget()
        cut = (np.frombuffer(x, dtype=f"<u{id_bytes}", count=n, offset=a * id_bytes) for x, a, n in zip(packed, starts, lengths, strict=True))
        return pd.Series([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], dtype="int64")

    return run(ids, start, length)


def _slot(table: Layout, length: str, rank: str) -> Column:
    """Sequence and place of the rest of a length with a rank; null for a rest that the layout leaves over."""
    starts, ends, firsts, places = (table.rows[:, 0] << RANK_BITS) + table.rows[:, 1], (table.rows[:, 0] << RANK_BITS) + table.rows[:, 2], table.rows[:, 3], table.rows[:, 4]

    @F.pandas_udf("struct<sequence: bigint, place: bigint>")
    def find(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        # All ids are written by now, and Spark deals these tasks to all idle workers in turn.
        forget()
        key = (lengths.to_numpy() << RANK_BITS) + ranks.to_numpy()
        at = np.searchsorted(starts, key, side="right") - 1
        if not len(starts):
            return pd.DataFrame({"sequence": [None] * len(key), "place": [None] * len(key)}, dtype="Int64")
        known = (at >= 0) & (key < ends[at])
        sequence, place = pd.Series(firsts[at] + key - starts[at], dtype="Int64"), pd.Series(places[at], dtype="Int64")
        return pd.DataFrame({"sequence": sequence.where(known), "place": place.where(known)})

    return find(length, rank)


def rest_layout(tokens: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> tuple[Layout, dict[int, int], int]:
    """The layout of the rests of ``tokens``, their histogram (at most ``window`` lengths), and the number of full windows."""
    rest, full = F.col("doc_tokens") % window, F.floor(F.col("doc_tokens") / window)
    found = tokens.groupBy(rest.alias("rest")).agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("full")).collect()
    histogram = {r.rest: r.n for r in found if r.rest}
    return layout(histogram, window, window // unit, depth), histogram, sum(r.full for r in found)


def pieces_of(tokens: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, id_bytes: int = 2) -> DataFrame:
    """rid, doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of ``tokens`` (as ``write_tokens`` wrote it)."""
    spark = tokens.sparkSession
    rows = tokens.select("rid", "doc_id", "doc_tokens", "rest_crc32", (F.col("doc_tokens") % window).alias("rest"), F.floor(F.col("doc_tokens") / window).alias("full"))
    chosen, histogram, full_windows = rest_layout(tokens, window, unit, depth)
    buckets = LEAST_BUCKETS + sum(histogram.values()) // ROWS_PER_BUCKET

    # Full windows are sequences of their own, numbered first.
    full = running_total(rows.where("full > 0").withColumn("all", F.lit(0)), ["all"], F.col("full"), "rid", buckets, "first")
    checks = tokens.where(F.size("full_crc32") > 0).select("rid", F.posexplode("full_crc32").alias("at", "ids_crc32"))
    full = full.select("rid", "doc_id", "doc_tokens", "first").join(checks, "rid").select(
        "rid", "doc_id", (F.col("at") * window).cast("bigint").alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("at")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )

    # Rests by the layout: rank within the length (a row per length says over how many parts it is counted), sequence and place of the rank.
    parts = spark.createDataFrame([(k, 1 + n // ROWS_PER_BUCKET) for k, n in histogram.items()], "rest bigint, parts bigint")
    rests = running_total(rows.join(F.broadcast(parts), "rest"), ["rest"], F.lit(1), "rid", F.col("parts"), "rank")
    placed = rests.withColumn("slot", _slot(chosen, "rest", "rank"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("full") * window).cast("bigint").alias("start")
    planned = placed.where("slot.sequence is not null").select(
        "rid", "doc_id", start, F.col("rest").alias("length"), F.col("rest_crc32").alias("ids_crc32"), "doc_tokens",
        (F.lit(full_windows) + F.col("slot.sequence")).alias("sequence_id"), F.col("slot.place").alias("place"),
    ).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))

    # Rests that are left over, end to end; those that a window's end cuts need their ids again for the checksums.
    loose = running_total(placed.where("slot.sequence is null").withColumn("all", F.lit(0)), ["all"], F.col("rest"), "rid", buckets, "from")
    windows = F.sequence(F.floor(F.col("from") / window), F.floor((F.col("from") + F.col("rest") - 1) / window))
    loose = loose.select("*", F.explode(windows).alias("window"))
    first = F.greatest(F.col("from"), F.col("window") * window)
    end = F.least(F.col("from") + F.col("rest"), (F.col("window") + 1) * window)
    loose = loose.select(
        "rid", "doc_id", (F.col("full") * window + first - F.col("from")).cast("bigint").alias("start"), (end - first).cast("bigint").alias("length"), F.col("rest_crc32").alias("ids_crc32"),
        "doc_tokens", (F.lit(full_windows + chosen.sequences) + F.col("window")).alias("sequence_id"), (first - F.col("window") * window).cast("bigint").alias("offset"), "rest",
    )
    whole = loose.where("length = rest")
    cut = loose.where("length < rest").drop("ids_crc32").join(tokens.select("rid", "ids"), "rid")
    cut = cut.withColumn("ids_crc32", _crc32_of("ids", "start", "length", id_bytes))
    return full.select(PIECE).unionAll(planned.select(PIECE)).unionAll(whole.select(PIECE)).unionAll(cut.select(PIECE))


def sequences_of(pieces: DataFrame, tokens: DataFrame, id_bytes: int = 2) -> DataFrame:
    """sequence_id, n_ids and the packed ids of every sequence; a group holds at most one window."""
    run = F.expr(f"substring(ids, CAST(start * {id_bytes} + 1 AS INT), CAST(length * {id_bytes} AS INT))")
    parts = pieces.join(tokens.select("rid", "ids"), "rid").select("sequence_id", "offset", "length", run.alias("ids"))
    grouped = parts.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", "n_ids", F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """The pieces of all documents (``pieces_of``); their tokens are written below the shared checkpoint folder."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, window)
    return pieces_of(docs.sparkSession.read.parquet(path), window, unit, depth, encoder(tokenizer).dtype.itemsize)
