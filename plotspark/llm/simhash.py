"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments: of two fingerprints that differ in at most ``max_bits`` bits, at least one
segment differs in at most one bit. Every distinct fingerprint is indexed under each segment's value and under each of the segment's
one-wildcard variants (the value with one bit taken out). Pairs with an equal segment meet under the value, pairs one bit apart meet under
the one variant whose taken-out bit is 0 in one and 1 in the other; a plain equality join finds both, and the whole fingerprints are then
compared. Keys under which very many fingerprints meet are cut further by exact pieces of the other bits, which loses no pair.

Defined results
* Words are runs of bytes other than space and \\x09-\\x0D; only A-Z is lower-cased. Texts of fewer words than a shingle are one shingle.
* A null text, an empty text and a text of white space have fingerprint zero and are linked like any other.
* Rows with a null doc_id take part; a component's id is its smallest non-null doc_id, null if it has none.
* Repeated rows share a fingerprint and a component; an empty table gives an empty table. Texts are read whole, at any length.
* Only the id and text columns are read; other columns, whatever their names, are ignored (``keep_one`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.llm.components import components
from plotspark.session import checkpointed

FINGERPRINT_BITS = 64
SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Fingerprints that may meet under one key before it is cut further.
KEY_ROWS = 256
HASHES_AT_ONCE = 1 << 16


def _hashes(words: list[bytes], size: int) -> Iterable[int]:
    if len(words) <= size:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    return map(xxhash.xxh64_intdigest, shingles, repeat(SEED))


def fingerprint_of(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of a whole text: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    return print_of(np.fromiter(_hashes(words, size), dtype="<u8", count=max(1, len(words) - size + 1)))


def print_of(hashes: np.ndarray) -> int:
    """The signed fingerprint of a text's shingle hashes, repeats included."""
    ones = np.zeros(FINGERPRINT_BITS, dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")

    return run(text)


def _bit_cuts(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``parts`` nearly equal cuts of the bits low to high - 1."""
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _cut(value: Column, start: int, width: int) -> Column:
    if width == FINGERPRINT_BITS:
        return value
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _rest(value: Column, start: int, width: int) -> Column:
    """The bits outside a segment as one number of 64 - width bits."""
    low = _cut(value, 0, start) if start else F.lit(0).cast("bigint")
    top = start + width
    return low if top == FINGERPRINT_BITS else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, top), start))


def _index(prints: DataFrame, max_bits: int, key_rows: int) -> DataFrame:
    """Rows (fp, segment, bit, key, side, piece): bit -1 is the exact value, otherwise the bit that is taken out; side is that bit."""
    fp = F.col("fp")
    segments = _bit_cuts(0, FINGERPRINT_BITS, max_bits // 2 + 1)
    values = F.array(*[F.struct(F.lit(g).alias("segment"), F.lit(w).alias("width"), _cut(fp, s, w).alias("value"), _rest(fp, s, w).alias("rest")) for g, (s, w) in enumerate(segments)])
    cut = prints.select("fp", F.inline(values))
    bits = F.sequence(F.lit(-1), F.col("width") - 1)
    whole = F.col("bit") < 0
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest("bit", F.lit(0)))
    key = F.when(whole, F.col("value")).otherwise(F.col("value").bitwiseAND(F.bitwise_not(mask)))
    side = F.when(whole, F.lit(-1)).otherwise(F.when(F.col("value").bitwiseAND(mask) == 0, 0).otherwise(1))
    variants = lambda df: df.withColumn("bit", F.explode(bits)).withColumn("key", key)
    index = variants(cut).withColumn("side", side).select("fp", "segment", "bit", "key", "side", "rest")
    # Segment values that very many fingerprints share, and every key under which they are indexed.
    crowded = cut.groupBy("segment", "width", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > key_rows)
    crowded = variants(crowded).select("segment", "bit", "key").distinct().withColumn("crowded", F.lit(True))
    index = index.join(crowded, ["segment", "bit", "key"], "left")
    rest_bits = {g: FINGERPRINT_BITS - w for g, (_, w) in enumerate(segments)}

    def pieces(width: int, apart: int) -> Column:
        """Of ``apart + 1`` pieces of the other bits, at least one is equal; the piece's number is kept in its lowest bits."""
        cuts = _bit_cuts(0, width, apart + 1)
        return F.array(*[_cut(F.col("rest"), s, w) * F.lit(FINGERPRINT_BITS) + F.lit(i) for i, (s, w) in enumerate(cuts)])

    finer = None
    for g, width in rest_bits.items():
        chosen = F.when(F.col("bit") < 0, pieces(width, max_bits)).otherwise(pieces(width, max_bits - 1))
        finer = chosen if finer is None else F.when(F.col("segment") == g, chosen).otherwise(finer)
    piece = F.when(F.col("crowded"), finer).otherwise(F.array(F.lit(-1).cast("bigint")))
    return index.select("fp", "segment", "bit", "key", "side", F.explode(piece).alias("piece"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b) for every two distinct fingerprints of ``prints`` (fp) that differ in at most ``max_bits`` bits; a pair may come up twice."""
    index = _index(prints, max_bits, key_rows)
    on = ["segment", "bit", "key", "piece"]
    left = index.where("side <= 0").withColumnRenamed("fp", "a").withColumnRenamed("side", "a_side")
    right = index.where("side != 0").withColumnRenamed("fp", "b").withColumnRenamed("side", "b_side")
    # Spark sizes the index by what it is exploded from, a row for 66, and would broadcast it whole.
    met = left.hint("merge").join(right.hint("merge"), on).where("a_side < 0 AND b_side < 0 AND a < b OR a_side = 0 AND b_side = 1")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def components_of(prints: DataFrame, max_bits: int = MAX_BITS, key_rows: int = KEY_ROWS) -> DataFrame:
    """fp, root for the fingerprints that are linked to a smaller one; ``prints`` has a column fp, repeats allowed."""
    found = components(links(prints.select("fp").distinct(), max_bits, key_rows))
    return found.withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, size: int = SHINGLE_WORDS, key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id and the component's rows (component_rows), one row per row of ``docs``."""
    prints = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), size).alias("fp")))
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("rows"))
    rooted = per_print.join(components_of(per_print, max_bits, key_rows), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"), F.sum("rows").alias("component_rows"))
    member = checkpointed(rooted.select("fp", "root").join(named, "root"))
    return prints.join(member, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_rows", "root",
    )


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of every component of ``docs`` with all its columns: the one with the smallest doc_id (nulls last), then text digest.

    Of rows that are equal in doc_id and text, one stays.
    """
    # A row is known by id and text digest. Repeated rows meet after a partial aggregate, and the join after it keeps that partitioning.
    known = ["__id", "__unknown", "__text"]
    marked = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__unknown": F.col("doc_id").isNull(), "__text": F.xxhash64("text")})
    prints = checkpointed(marked.select(*known, fingerprint(F.col("text"), size).alias("fp")))
    rooted = prints.select("fp").distinct().join(components_of(prints, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = prints.join(rooted, "fp").groupBy("root").agg(F.min(F.struct("__unknown", "__id", "__text")).alias("first")).select("first.*")
    return marked.dropDuplicates(known).join(first, known, "left_semi").drop(*known)
