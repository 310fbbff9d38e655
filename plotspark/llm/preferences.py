"""Preference pairs: the common start of two conversations as one prompt, and what follows as two masked completions.

The turns of both conversations are numbered and compared place by place; the first place where role or text differ, or one of them ends, is
where the prompt ends. The prompt's turns are rendered once; the turns after it are rendered for each side, and carry loss only where the
assistant speaks. Segments are rows, one per turn, so a conversation of any length is never gathered in one place; offsets come from
sums over blocks of turns.

Defined results
* Turns are ordered by turn number (nulls first), then role, then text. A null role or text is rendered as an empty one.
* Turns with a null conversation id belong to no conversation. Pairs with a null or unknown id get the turns of the side that exists.
* Two equal conversations, repeated rows included, are all prompt and have no completion. A pair that is listed twice is rendered twice.
* Empty tables give an empty table. Only the named columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotspark.session import checkpointed

TURNS_PER_BLOCK = 256
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def numbered(turns: DataFrame, key: list[str], turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """``turns`` (key, turn, role, text) with their place from 0 in their conversation.

    Blocks of turn numbers are counted first, so only a block's turns are sorted together.
    """
    rows = turns.withColumn("__block", F.coalesce(F.floor(F.col("turn") / turns_per_block), F.lit(-(1 << 62))))
    sizes = rows.groupBy(*key, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy(*key, "__block").orderBy("turn", "role", "text")
    return rows.join(starts, [*key, "__block"]).withColumn("place", F.col("__first") + F.row_number().over(own) - 1).drop("__block", "__first")


def segments(chosen: DataFrame, rejected: DataFrame, places_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), place, role, rendered, loss and offset, from two tables of turns (pair_id, turn, role, text).

    ``place`` counts the turns of a conversation, ``offset`` the characters of the part before the turn; ``loss`` is true where a
    completion's assistant speaks.
    """
    sides = [numbered(s.where("pair_id is not null").select("pair_id", "turn", "role", "text"), ["pair_id"]).withColumn("side", F.lit(name)) for s, name in ((chosen, "chosen"), (rejected, "rejected"))]
    both = checkpointed(sides[0].unionAll(sides[1]))
    turn = F.struct(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    meets = both.groupBy("pair_id", "place").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("low"), F.max(turn).alias("high"))
    same = (F.col("n") == 2) & (F.col("low") == F.col("high"))
    prompt = meets.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~same, F.col("place"))), F.max("place") + 1).alias("prompt_turns"))
    rows = both.join(prompt, "pair_id")
    shared = F.col("place") < F.col("prompt_turns")
    rows = rows.where(~shared | (F.col("side") == "chosen")).withColumn("part", F.when(shared, "prompt").otherwise(F.col("side")))
    rows = rows.withColumn("rendered", render(F.col("role"), F.col("text")))
    rows = rows.withColumn("loss", (F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False)))
    # Offsets: characters of a part's earlier blocks, then of the turns before in the block.
    rows = rows.withColumn("__block", F.floor(F.col("place") / places_per_block)).withColumn("__chars", F.length("rendered").cast("bigint"))
    key = ["pair_id", "part"]
    sums = rows.groupBy(*key, "__block").agg(F.sum("__chars").alias("__sum"))
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    own = Window.partitionBy(*key, "__block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("__start") + F.coalesce(F.sum("__chars").over(own), F.lit(0))
    return rows.join(starts, [*key, "__block"]).select("pair_id", "part", "place", "role", "rendered", "loss", offset.alias("offset"))


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns (pair_id, turn, role, text) from a table of conversations that holds no preference.

    Every conversation is chosen over itself with its last reply exchanged for the last reply of its neighbour (the other id of 2k and
    2k + 1). A conversation without a reply, or whose neighbour has none, is left as it is on both sides.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    reply = F.struct(F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    last = turns.where("role = 'assistant' and turn is not null").groupBy("conv_id").agg(F.max(reply).alias("reply"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("conv_id"), F.col("reply.text").alias("__other"))
    exchange = last.select("conv_id", F.col("reply.turn").alias("__turn"), F.col("reply.text").alias("__text")).join(other, "conv_id")
    rows = turns.join(exchange, "conv_id", "left")
    changed = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("__turn")) & (F.coalesce("text", F.lit("")) == F.col("__text")), F.lit(False))
    rejected = rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(changed, F.col("__other")).otherwise(F.col("text")).alias("text"))
    return turns.withColumnRenamed("conv_id", "pair_id"), rejected
