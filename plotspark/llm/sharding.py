"""Jump consistent hashing of stable keys to shards, and gapless slots within the shards.

The hash follows Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm": a key walks through its own
random sequence of ever higher shards and stays at the last one below the shard count. No ring or table is kept, and one
more shard takes rows only into itself. Everything is a Spark SQL expression.

Defined results
* A null key is hashed as the empty string; equal keys always share a shard.
* A null text has size 8 (the fixed part) and checksum 0; a very long text is only measured, never split.
* Rows equal in every ordering column get neighbouring slots; which of them gets which makes no difference.
* An empty table gives an empty table. Columns of the input that are not named in the call are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The multiplier of the published generator, split into 32-bit halves, and masks.
MULTIPLIER = 2862933555777941757
MULTIPLIER_HIGH, MULTIPLIER_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK16, MASK32 = 0xFFFF, 0xFFFFFFFF

FIRST_STEPS = 64
COPIES_PER_ROW = 4096


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of key * MULTIPLIER + 1 modulo 2^64; no product or sum leaves 63 bits."""
    low0, low1 = low.bitwiseAND(_long(MASK16)), F.shiftright(low, 16)
    part0, part1 = low0 * _long(MULTIPLIER_LOW), low1 * _long(MULTIPLIER_LOW)
    short = part0 + F.shiftleft(part1.bitwiseAND(_long(MASK16)), 16) + _long(1)
    carry = F.shiftright(short, 32) + F.shiftright(part1, 16)
    high0, high1 = high.bitwiseAND(_long(MASK16)), F.shiftright(high, 16)
    crossed = high0 * _long(MULTIPLIER_LOW) + F.shiftleft((high1 * _long(MULTIPLIER_LOW)).bitwiseAND(_long(MASK16)), 16)
    upper = carry + (low * _long(MULTIPLIER_HIGH)).bitwiseAND(_long(MASK32)) + crossed.bitwiseAND(_long(MASK32))
    return upper.bitwiseAND(_long(MASK32)), short.bitwiseAND(_long(MASK32))


def key_state(key: Column) -> Column:
    """The first 64 bits of the key text's md5 as two 32-bit halves."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return F.struct(half(1).alias("high"), half(9).alias("low"), F.lit(-1).cast("bigint").alias("shard"), _long(0).alias("ahead"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of each key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    count = _long(shards)

    def jump(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        ahead = F.floor((state["ahead"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(high.alias("high"), low.alias("low"), state["ahead"].alias("shard"), ahead.alias("ahead"))
        return F.when(state["ahead"] < count, moved).otherwise(state)

    # A key jumps about ln(shards) times; the second pass is only evaluated for the keys that are not done after the first.
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS))), key_state(key), jump)
    if shards > FIRST_STEPS:
        rest = F.sequence(F.lit(1), F.lit(shards))
        state = F.aggregate(F.array(F.lit(0)), state, lambda s, _: F.when(s["ahead"] < count, F.aggregate(rest, s, jump)).otherwise(s))
    return state["shard"].cast("int")


def with_shards(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; a map over rows without any shuffle."""
    return df.withColumn(name, jump_hash(F.col(key), shards))


def with_slots(df: DataFrame, shard: str, order: list[str], buckets: int = 4096, slot: str = "slot") -> DataFrame:
    """One row per row of ``df`` with its shard, the ``order`` columns and a slot counted from 0 in its shard.

    Rows are ranked by a digest bucket and then by ``order``. Equal rows are counted before they meet and get consecutive slots, so neither
    a shard nor a repeated row has to fit one task; ``buckets`` bounds what one window sorts to 1 / buckets of a shard's different rows.
    """
    columns = [shard, *order]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.withColumn("__bucket", F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, [shard, "__bucket"]).withColumn("__first", F.col("__start") + F.coalesce(F.sum("__n").over(within), F.lit(0)))
    blocks = placed.select(*columns, "__n", "__first", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1), F.lit(COPIES_PER_ROW))).alias("__block"))
    blocks = blocks.repartition(*[F.col(c) for c in order], F.col("__block"))
    last = F.least(F.col("__n") - 1, F.col("__block") + COPIES_PER_ROW - 1)
    copies = blocks.select(*columns, "__first", F.explode(F.sequence(F.col("__block"), last)).alias("__copy"))
    return copies.select(*columns, (F.col("__first") + F.col("__copy")).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 24, buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard under one more shard (grown_shard) of every document.

    Size is the UTF-8 length of the text plus 8; the checksum is the unsigned CRC-32 of the UTF-8 text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = with_slots(with_shards(digests, "doc_id", shards), "shard", ["doc_id", "size", "text_crc32"], buckets)
    return with_shards(placed, "doc_id", shards + 1, "grown_shard")
