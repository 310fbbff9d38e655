"""Near copies by word shingles: SimHash links and MinHash bands for candidates, exact Jaccard similarity of the shingle sets as verification.

Every content has the SimHash fingerprint of its shingles, and ``simhash.links`` finds the fingerprints that are at most ``simhash.MAX_BITS`` bits
apart through their deletion variants; of the contents of one fingerprint the smallest stands for them. Near a similarity of 0.8 two fingerprints
differ in about 10 bits, and often in 15; segments that reach this have 8 bits, under which nearly every pair of a large corpus meets. So further
candidates come from bands: of ``BANDS`` keys made of ``ROWS`` minima each, two texts of similarity 0.8 share one with a chance of 0.998, and texts of
similarity 0.3 with a chance of 0.014.

Texts of equal words are one content. Contents that meet under a band's key, under one fingerprint or under two linked ones are compared with the
smallest of them. Where this leaves them in several groups, all of them are compared: up to ``PIECE_ROWS`` pair by pair, larger ones in pairs
of blocks of bounded size, each pair of blocks a group of its own, so no task holds a crowd and no link is lost. Blocks whose sizes rule the
similarity out, and blocks of one group that was found before, do not meet. A pair is linked only if its exact similarity reaches the limit;
groups are the connected components.

Defined results
* Words are runs of bytes other than space and \\x09-\\x0D; only A-Z is lower-cased. Texts of fewer words than a shingle are one shingle.
* Null, empty and blank texts are copies of each other. Rows with a null doc_id take part. An empty table gives an empty table.
* Texts are read whole, at any length. Columns of any name are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.llm import simhash
from plotspark.llm.components import components
from plotspark.llm.simhash import SEED, _hashes
from plotspark.llm.small import settled
from plotspark.llm.workers import dropped
from plotspark.operators.ranking import salted_join
from plotspark.session import checkpointed

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: Contents under one key that are compared pair by pair; the contents of a block beyond that, and the shingles of all of them.
PIECE_ROWS = 32
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
HASHES_AT_ONCE = 1 << 12

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; none for a text without words."""
    words = _words(text)
    return np.unique(np.fromiter(_hashes(words, size), dtype=np.uint64)) if words else np.zeros(0, np.uint64)


def sketch_of(text: str | None, size: int = SHINGLE_WORDS) -> tuple[int, int, list[int]]:
    """Digest of a text's words, the SimHash fingerprint of its shingles, and one key per band."""
    words = _words(text)
    if not words:
        return 0, 0, []
    every = np.fromiter(_hashes(words, size), dtype="<u8")
    hashes = np.unique(every)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        np.minimum(least, (_FACTORS * hashes[at : at + HASHES_AT_ONCE]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes()) for i in range(0, BANDS * ROWS, ROWS)]
    digest = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return int(np.uint64(digest).view(np.int64)), simhash.print_of(every), np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def sketch(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("struct<fp: bigint, print: bigint, bands: array<bigint>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        dropped("tokens")  # of a job before
        return pd.DataFrame([sketch_of(t, size) for t in texts], columns=["fp", "print", "bands"])

    return run(text)


def shingles(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t, size).view(np.int64) for t in texts])

    return run(text)


def _sets(nodes: DataFrame, contents: DataFrame, texts: DataFrame, known: list[str], size: int) -> DataFrame:
    """fp, set (the shingles) of the contents ``nodes`` (fp); only their texts are read again."""
    wanted = settled(contents.join(nodes, "fp", "left_semi").select("fp", "first.*"))
    return checkpointed(texts.join(wanted, known).dropDuplicates(["fp"]).select("fp", shingles(F.col("__words"), size).alias("set")))


def _similar(pairs: DataFrame, contents: DataFrame, texts: DataFrame, known: list[str], similarity: float, size: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose contents reach the similarity."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), contents, texts, known, size)
    # One content may be compared with very many others.
    per_first = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"))
    firsts = checkpointed(sets.withColumnsRenamed({"fp": "a", "set": "a_set"}).join(per_first, "a"))
    both = salted_join(pairs.join(sets.withColumnsRenamed({"fp": "b", "set": "b_set"}), "b"), firsts, ["a"], "pairs")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    either = F.size("a_set") + F.size("b_set")
    counted = both.select("a", "b", shared.alias("shared"), either.alias("either"))
    return checkpointed(counted.where(F.col("shared") >= similarity * (F.col("either") - F.col("shared")) - 1e-9).select("a", "b"))


def alike(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """For each set of ``a`` the places of the sets of ``b`` that reach the similarity; sets are arrays of different numbers."""
    sizes = np.array([len(x) for x in b])
    hashes, owner = np.concatenate(b), np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    for own in a:
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[at], minlength=len(b))
        yield np.flatnonzero(shared >= similarity * (len(own) + sizes - shared) - 1e-9)


def _crowd_links(crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the groups (root) of all similar contents under a crowded key; ``crowds`` has band, key, fp and root.

    Under a key the contents are cut by size, so that only neighbouring sizes can reach the similarity, and into blocks; a group that fills a
    block has blocks of its own. Every pair of blocks is compared whole, and yields at most a link less than it holds groups.
    """
    key, block = ["band", "key"], ["step", "whole", "own", "piece"]
    # Sizes that are a step further apart cannot reach the similarity; a hair wider, so that rounding parts none.
    step = F.size("set") if similarity >= 1 else F.floor(F.log(F.greatest(F.size("set"), F.lit(1)).cast("double")) / (-math.log(similarity) * (1 + 1e-9)))
    rows = crowds.join(checkpointed(sets.select("fp", step.cast("bigint").alias("step"), F.size("set").alias("size"))), "fp")
    limit = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_SHINGLES / F.greatest(F.max("size"), F.lit(1))))).alias("limit")
    limits = rows.groupBy(*key, "step").agg(limit)
    per_root = rows.groupBy(*key, "step", "root").agg(F.count(F.lit(1)).alias("weight")).join(limits, [*key, "step"])
    whole = F.col("weight") >= F.col("limit")
    per_root = per_root.withColumns({"whole": whole, "own": F.when(whole, F.col("root")).otherwise(0)})
    filled = per_root.groupBy(*key, *block[:3]).agg(F.ceil(F.sum("weight") / F.max("limit")).alias("pieces"))
    cut = checkpointed(per_root.drop("limit").join(filled, [*key, *block[:3]]))
    dealt = salted_join(rows.drop("size"), cut, [*key, "step", "root"], "weight")
    dealt = checkpointed(dealt.withColumn("piece", F.pmod(F.xxhash64("fp", "band"), "pieces")).select(F.xxhash64(*key, *block).alias("id"), *key, *block, "fp", "root"))
    blocks = checkpointed(dealt.select("id", *key, *block).distinct())
    low = blocks.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("id", *block)])
    met = low.join(blocks, key).where("(step = a_step AND id >= a_id OR step = a_step + 1) AND NOT (whole AND a_whole AND own = a_own)")
    pairs = checkpointed(met.select("a_id", F.col("id").alias("b_id")))
    sent = pairs.select("a_id", "b_id", F.explode(F.array_distinct(F.array("a_id", "b_id"))).alias("id"))
    travels = dealt.select("id", "fp", "root").join(sets, "fp").join(sent, "id")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:  # two blocks
        pdf = pdf.sort_values("fp", kind="stable")
        a, b = pdf[pdf["id"] == pdf["a_id"]], pdf[pdf["id"] == pdf["b_id"]]
        a_fp, a_root, b_fp, b_root = (v.tolist() for v in (a["fp"], a["root"], b["fp"], b["root"]))
        root_of: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root_of.get(x, x)) != x:
                root_of[x] = root_of.get(up, up)
                x = up
            return x

        found = []
        for i, places in enumerate(alike(a["set"].tolist(), b["set"].tolist(), similarity)):
            for k in places.tolist():
                x, y = find(a_root[i]), find(b_root[k])
                if x != y:
                    root_of[max(x, y)] = min(x, y)
                    found.append((min(a_fp[i], b_fp[k]), max(a_fp[i], b_fp[k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return checkpointed(travels.groupBy("a_id", "b_id").applyInPandas(link, "a bigint, b bigint").distinct())


def _print_links(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """print, head (the smallest content) and rows of every fingerprint of ``contents`` (fp, print); and the linked ones: a, b, and both heads and rows."""
    prints = checkpointed(contents.groupBy("print").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("rows")))
    linked = simhash.links(prints.select(F.col("print").alias("fp"))).distinct()
    for side in ("a", "b"):
        linked = linked.join(prints.select(F.col("print").alias(side), F.col("head").alias(f"{side}_head"), F.col("rows").alias(f"{side}_rows")), side)
    return prints, checkpointed(linked)


def print_pairs(contents: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b), a < b: contents (fp, print) of equal fingerprints, each with the smallest, and the smallest ones of linked fingerprints."""
    prints, linked = known or _print_links(contents)
    same = salted_join(contents.select("fp", "print"), prints.where("rows > 1"), ["print"], "rows").where("fp != head")
    near = linked.select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return same.select(F.col("head").alias("a"), F.col("fp").alias("b")).unionAll(near)


def _print_rows(contents: DataFrame, known: tuple[DataFrame, DataFrame]) -> DataFrame:
    """band, key, fp, n: the contents that meet under one fingerprint (band -1) or under two linked ones (band -2), beyond a pair that ``print_pairs`` has."""
    prints, linked = known
    alone = prints.where("rows > 2").select(F.lit(-1).alias("band"), F.col("print").alias("key"), "print", F.col("rows").alias("n"), "rows")
    both = linked.where("a_rows + b_rows > 2").select(F.lit(-2).alias("band"), F.xxhash64("a", "b").alias("key"), (F.col("a_rows") + F.col("b_rows")).alias("n"),
                                                      F.inline(F.array(F.struct(F.col("a").alias("print"), F.col("a_rows").alias("rows")), F.struct(F.col("b").alias("print"), F.col("b_rows").alias("rows")))))
    keys = checkpointed(alone.unionAll(both.select(alone.columns)))
    return salted_join(contents.select("fp", "print"), keys, ["print"], "rows").select("band", "key", "fp", "n")


def _rooted(contents: DataFrame, links: DataFrame) -> DataFrame:
    """fp, root of every content."""
    found = components(links).withColumnsRenamed({"node": "fp"})
    return contents.select("fp").join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(contents: DataFrame, texts: DataFrame, known: list[str], similarity: float, size: int) -> DataFrame:
    """fp, root of every row of ``contents`` (fp, print, bands, first); ``first`` holds the ``known`` columns of a row of ``texts`` with that content."""
    bands = contents.select("fp", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a")).where("n > 1")
    buckets = checkpointed(buckets.withColumn("rows", F.col("n")))
    prints = _print_links(contents)
    met = checkpointed(salted_join(bands, buckets, ["band", "key"], "rows"))
    stars = checkpointed(met.where("fp != a").select("a", F.col("fp").alias("b")).unionAll(print_pairs(contents, prints)).distinct())
    links = _similar(stars, contents, texts, known, similarity, size)
    rooted = checkpointed(_rooted(contents, links))
    # Keys whose contents are not yet one group.
    open_rows = met.where("n > 2").select("band", "key", "fp", "n").unionAll(_print_rows(contents, prints)).join(rooted, "fp")
    several = open_rows.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high")
    several = checkpointed(several.select("band", "key", "rows"))
    left_open = checkpointed(salted_join(open_rows, several, ["band", "key"], "rows").select("band", "key", "n", "fp", "root"))
    few, crowds = left_open.where(F.col("n") <= PIECE_ROWS).drop("n"), left_open.where(F.col("n") > PIECE_ROWS).drop("n")
    on = ["band", "key"]
    left, right = few.withColumnsRenamed({"fp": "a", "root": "a_root"}), few.withColumnsRenamed({"fp": "b", "root": "b_root"})
    pairs = left.join(right, on).where("a < b AND a_root != b_root").select("a", "b").distinct()
    pairs = checkpointed(pairs.join(stars, ["a", "b"], "left_anti"))
    links = links.unionAll(_similar(pairs, contents, texts, known, similarity, size))
    if not crowds.isEmpty():
        links = links.unionAll(_crowd_links(crowds, _sets(crowds.select("fp").distinct(), contents, texts, known, size), similarity))
    return _rooted(contents, links)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of every group of near copies with all its columns: the one with the smallest doc_id (nulls last), then text digest.

    Of rows that are equal in doc_id and text, one stays.
    """
    known = ["__unknown", "__id", "__text"]
    marked = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__unknown": F.col("doc_id").isNull(), "__text": F.xxhash64("text")})
    sketched = marked.select(*known, sketch(F.col("text"), size).alias("sketch")).select(*known, "sketch.*")
    contents = sketched.groupBy("fp").agg(F.min(F.struct(*known)).alias("first"), F.min("print").alias("print"), F.min("bands").alias("bands"))
    contents = checkpointed(contents)
    rooted = groups(contents, marked.select(*known, F.col("text").alias("__words")), known, similarity, size)
    first = contents.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return marked.dropDuplicates(known).join(first, known, "left_semi").drop(*known)
