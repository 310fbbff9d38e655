"""Spelling variants grouped under their frequent form, by probing generated edits against Bloom filters of the vocabulary.

Two words are near if one inserted, deleted or replaced letter apart. Of every word all deletions, and all replacements by a later letter of the
alphabet, are generated as numbers only (a word's digest is the sum of its letters' digests by place, so an edit changes few terms) and probed
against blocked Bloom filters, one per word length, that every task holds. What a filter takes is spelled out and shuffled to an equality join
with the vocabulary, which removes the false positives; an insertion is a deletion seen from the other word. No pair of a word and a stranger
ever exists as a row, and no pair is lost, since filters have no false negatives.

The filters of a pass have at most ``filter_bytes`` in all, whatever the vocabulary: beyond that the vocabulary is split by digest over several
passes, each with filters of its own part.

Defined results
* Words are rows (word, n) with distinct, non-null words; ``count_words`` makes them of texts. Null texts have none, texts are read whole, at any length.
* A word's form is its near word with the largest n, of equal ones the smallest in code-point order, if that n is ``ratio`` times its own or more.
* The root is where the forms lead; n grows along them, so they always end. A word without a form is its own root.
* A null doc_id is an empty one. Repeated rows count each. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotspark.session import checkpointed

RUNS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
FILTER_BYTES = 32 << 20
BITS_A_WORD, PROBES, LANES = 16, 6, 8
WORDS_AT_ONCE = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Filters = dict[int, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix (Steele et al., 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _term(place: np.ndarray | int, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to its word's digest."""
    return _mixed((np.asarray(place, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + letter.astype(np.uint64))


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Length and places of the words of that length, few at once."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    for length in np.unique(lengths):
        places = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
        few = max(1, min(WORDS_AT_ONCE, (1 << 20) // max(1, int(length))))
        for at in range(0, len(places), few):
            yield int(length), places[at : at + few].tolist()


def _bits(digests: np.ndarray, blocks: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in the filter and bit of a probe: all probes of a digest lie in one block."""
    with np.errstate(over="ignore"):
        mixed = _mixed(digests)
        block = ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        chosen = _mixed(mixed + np.uint64(probe + 1))
    return block * np.uint64(LANES) + (chosen & np.uint64(LANES - 1)), np.uint64(1) << ((chosen >> np.uint64(8)) & np.uint64(63))


def _in_pass(digests: np.ndarray, turn: int, turns: int) -> np.ndarray:
    return _mixed(digests ^ np.uint64(0xA5A5A5A5)) % np.uint64(turns) == np.uint64(turn)


def _taken(filters: Filters, length: int, digests: np.ndarray, turn: int, turns: int) -> np.ndarray:
    """Places of the digests that the filter of a length takes."""
    lanes = filters.get(length)
    if lanes is None:
        return np.zeros(0, np.int64)
    left = np.arange(len(digests)) if turns == 1 else np.flatnonzero(_in_pass(digests, turn, turns))
    for probe in range(PROBES):
        place, bit = _bits(digests[left], len(lanes) // LANES, probe)
        left = left[(lanes[place] & bit) != 0]
    return left


def _blocks(words: int) -> int:
    return -(-words * BITS_A_WORD // (64 * LANES))


def _filters(vocabulary: DataFrame, sizes: dict[int, int], turn: int, turns: int) -> Filters:
    """Lanes of every length's filter over the words of a pass."""
    blocks = {length: _blocks(-(-n // turns)) for length, n in sizes.items()}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, places in _by_length(words):
                with np.errstate(over="ignore"):
                    digests = _term(np.arange(length), _letters([words[i] for i in places], length)).sum(axis=1, dtype=np.uint64)
                digests = digests[_in_pass(digests, turn, turns)] if turns > 1 else digests
                for probe in range(PROBES):
                    place, bit = _bits(digests, blocks[length], probe)
                    columns = [pa.array(np.full(len(place), length, np.int32)), pa.array(place.astype(np.int64)), pa.array(bit.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["length", "place", "bits"])

    rows = vocabulary.select("word").mapInArrow(bits, "length int, place bigint, bits bigint")
    rows = rows.groupBy("length", "place").agg(F.bit_or("bits").alias("bits")).toPandas()
    found = {length: np.zeros(n * LANES, np.uint64) for length, n in blocks.items()}
    for length, part in rows.groupby("length"):
        found[int(length)][part["place"].to_numpy()] = part["bits"].to_numpy().view(np.uint64)
    return found


def _edits(words: list[str], counts: list[int], alphabet: np.ndarray, filters: Filters, turn: int, turns: int) -> Iterator[tuple[str, int, str]]:
    """Word, its n, and every edit of it that a filter takes."""
    letters = [chr(c) for c in alphabet]
    for length, places in _by_length(words):
        if not length:
            continue
        few = [words[i] for i in places]
        with np.errstate(over="ignore"):
            codes = _letters(few, length)
            terms = _term(np.arange(length), codes)
            shifted = _term(np.arange(length) - 1, codes)
            whole = terms.sum(axis=1, dtype=np.uint64)
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            behind = shifted.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(shifted, axis=1, dtype=np.uint64)
            # Of a run of equal letters one deletion is enough.
            row, at = np.nonzero(np.concatenate([np.ones((len(few), 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1))
            for k in _taken(filters, length - 1, (before + behind)[row, at], turn, turns).tolist():
                word, p = few[row[k]], int(at[k])
                yield word, counts[places[row[k]]], word[:p] + word[p + 1 :]
            for p in range(length):
                row, put = np.nonzero(alphabet[None, :] > codes[:, p : p + 1])
                digests = (whole - terms[:, p])[row] + _term(p, alphabet)[put]
                for k in _taken(filters, length, digests, turn, turns).tolist():
                    word = few[row[k]]
                    yield word, counts[places[row[k]]], word[:p] + letters[put[k]] + word[p + 1 :]


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of near words of ``vocabulary`` (word, n)."""
    spark = vocabulary.sparkSession
    shape = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()
    sizes = {r.length: r.words for r in shape if r.length is not None}
    alphabet = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    alphabet = np.array(sorted(ord(r.c) for r in alphabet if r.c), dtype=np.uint32)
    turns = max(1, -(-sum(_blocks(n) * 8 * LANES for n in sizes.values()) // filter_bytes))
    others = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = None
    for turn in range(turns):
        filters = spark.sparkContext.broadcast(_filters(vocabulary, sizes, turn, turns))

        def probe(batches: Iterator[pa.RecordBatch], turn: int = turn, filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = list(_edits(batch.column(0).to_pylist(), batch.column(1).to_pylist(), alphabet, filters.value, turn, turns))
                columns = list(zip(*pairs, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["word", "n", "near"])

        probed = vocabulary.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(probe, "word string, n bigint, near string")
        exact = checkpointed(probed.join(others, "near").select("word", "n", "near", "near_n"))
        filters.destroy()
        found = exact if found is None else found.unionAll(exact)
    return found.unionAll(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary`` (word, n)."""
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    judged = near_words(vocabulary, filter_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = vocabulary.select("word", F.col("n").cast("bigint").alias("n")).join(judged, "word", "left")
    far = -F.col("best.m") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.w")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    rows = checkpointed(rows)
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # Every round doubles the length of the way.
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpointed(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """word, n of all runs of letters of whole texts, A-Z lower-cased, with ``min_length`` letters and ``min_count`` occurrences or more.

    ``drop_every``: a run whose crc32 (of id, ``:`` and the run) it divides loses the letter at crc32 % length, as if misspelled.
    """
    runs = F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUNS), F.lit(0)), lambda r: F.length(r) >= min_length)
    words = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if drop_every is not None:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def spelling_variants(docs: DataFrame, drop_every: int | None = None) -> DataFrame:
    """The variants of all words of ``docs``."""
    return group_variants(checkpointed(count_words(docs, drop_every=drop_every)))
