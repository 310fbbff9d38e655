"""Benchmark passages in documents, found by edit distance: CGK embedding, bit-sampling LSH, exact verification.

The CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) walks over a word sequence and emits a word per step, advancing by a random bit that
depends on the step and the word. Two sequences a few edits apart fall into step again, so edit distance becomes Hamming distance. Each
repetition uses a new walk and a new sample of its steps as the hash key. How many repetitions an item length needs for the target recall is
measured on the items themselves, with as many random edits as the limit allows.

Windows have the size of an item. A window that shares too few word pairs with the items of that length to lie within the edit limit
(n - 1 - 2 d of n - 1 pairs) is not embedded; this bound is exact and drops no match. Where the edit limit leaves no such number of pairs, every
window is embedded. Every window and item whose keys meet are compared by exact edit distance, so what is reported is always right; only recall
is a matter of the repetitions. Where ``MOST_REPETITIONS`` do not reach the target recall, every window within the bound is compared with every
item of its length instead, which misses nothing.

Documents are only mapped, never shuffled. Benchmark items are read in blocks of bounded size, each against all documents.

Defined results
* Words are runs of Unicode letters and digits, with their marks, in lower case; of scripts written without spaces every character is a word.
  Punctuation, symbols, every kind of space and case make no difference; invisible joiners and soft hyphens are left out.
* An item matches where a run of the document is within ``(1 - similarity) * words`` word edits of it; at 0.8 items of under 5 words must match
  exactly. A similarity that is not above 0 and at most 1 is an error.
* Null and empty texts and items have no words and match nothing. Texts and items are read whole, at any length.
* Of several places in one document the nearest counts, then the first. Equal items are reported each. Repeated rows are each judged.
* Empty tables give no match. Only the text columns are read; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8
RECALL = 0.95
SAMPLES = 4
#: Repetitions are planned in rounds of this many, up to the most.
ROUND = 4
MOST_REPETITIONS = 400
BLOCK_BYTES = 8 << 20
PAIR_BITS = 20
WALKS_AT_ONCE = 1 << 20
SEED = 20160619

#: Letters of scripts without spaces between words: Thai, Lao, Tibetan, Myanmar, Khmer, Han and kana.
_UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
             (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: Soft hyphen, joiners and byte order mark, which stand inside words and are not seen.
_UNSEEN = (0xAD, 0x200C, 0x200D, 0x2060, 0xFEFF)


class _Signs(dict):
    """What each character of a text becomes before it is cut at white space."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if code in _UNSEEN or 0xFE00 <= code <= 0xFE0F:
            self[code] = None
        elif not (c.isalnum() or kind[0] == "M"):
            self[code] = " "
        elif any(low <= code <= high for low, high in _UNSPACED):
            self[code] = f" {c} "
        else:
            self[code] = c
        return self[code]


_SIGNS = _Signs()
_WORD_BYTES = bytes((c if c < 128 and chr(c).isalnum() else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if text.isascii():
        return text.encode().translate(_WORD_BYTES).split()
    return text.translate(_SIGNS).encode("utf-8", "surrogatepass").split()


def most_edits(words: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * words + 1e-9)


def edit_distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each row of ``items`` and any run of the same row of ``texts``, and where the first such run ends."""
    rows, width = texts.shape
    steps = np.arange(width + 1, dtype=np.int32)
    last = np.zeros((rows, width + 1), dtype=np.int32)
    for i in range(items.shape[1]):
        now = last + 1
        now[:, 1:] = np.minimum(now[:, 1:], last[:, :-1] + (texts != items[:, i : i + 1]))
        last = np.minimum.accumulate(now - steps, axis=1) + steps
    return last.min(axis=1), last.argmin(axis=1)


class _Walks:
    """Random walks over windows of ``words`` words: one row of coefficients and of sampled steps per repetition."""

    def __init__(self, words: int, samples: int, repetitions: int):
        rng = np.random.default_rng([SEED, words])
        steps = 3 * words
        self.words = words
        self.factor = np.zeros((repetitions, steps), dtype=np.uint32)
        self.shift = np.zeros((repetitions, steps), dtype=np.uint32)
        self.sampled = np.zeros((repetitions, steps), dtype=bool)
        for r in range(repetitions):  # row by row, so that more repetitions leave the first ones as they are
            self.factor[r] = rng.integers(0, 1 << 32, size=steps, dtype=np.uint64) | np.uint64(1)
            self.shift[r] = rng.integers(0, 1 << 32, size=steps, dtype=np.uint64)
            self.sampled[r, rng.choice(steps, size=min(samples, steps), replace=False)] = True
        self.last = int(np.flatnonzero(self.sampled.any(axis=0))[-1])

    def keys(self, ids: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
        """Key of each window (columns) under each repetition (rows); steps past a window's end emit ``pad``."""
        place = np.broadcast_to(starts, (len(self.factor), len(starts))).copy()
        end = starts + self.words
        keys = np.zeros(place.shape, dtype=np.uint64)
        for step in range(self.last + 1):
            inside = place < end
            word = np.where(inside, ids[np.where(inside, place, 0)], pad).astype(np.uint32)
            rows = np.flatnonzero(self.sampled[:, step])
            if len(rows):
                mixed = (keys[rows] + word[rows]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
                keys[rows] = mixed ^ (mixed >> np.uint64(29))
            place += (word * self.factor[:, step, None] + self.shift[:, step, None]) >> np.uint32(31)
        return keys


@dataclass
class _Length:
    """The items of one length, the walks of every repetition and the items' sorted keys under each; without walks all windows are compared."""

    words: int
    edits: int
    items: np.ndarray
    rows: np.ndarray
    walks: _Walks | None = None
    tables: list = field(default_factory=list)


class Matcher:
    """A block of benchmark items, ready to be found in texts."""

    def __init__(self, item_ids: list, texts: list[str], similarity: float = SIMILARITY, recall: float = RECALL, samples: int = SAMPLES):
        if not 0 < similarity <= 1:
            raise ValueError(f"similarity {similarity} is not above 0 and at most 1")
        cut = [(i, words_of(t)) for i, t in zip(item_ids, texts, strict=True)]
        cut = [(i, w) for i, w in cut if w]
        self.item_ids = [i for i, _ in cut]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, words in cut for w in words}))}
        self.pad = len(self.vocabulary) + 1
        self.samples, self.recall, self.similarity = samples, recall, similarity
        by_length: dict[int, list[int]] = {}
        coded = [np.array([self.vocabulary[w] for w in words], dtype=np.int32) for _, words in cut]
        for k, c in enumerate(coded):
            by_length.setdefault(len(c), []).append(k)
        # Which lengths have an item with a word pair, one bit for a length (or for several, beyond 64 of them: more windows, no fewer matches).
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=np.uint64)
        self.lengths = []
        for at, (n, rows) in enumerate(sorted(by_length.items())):
            items = np.stack([coded[k] for k in rows])
            length = _Length(n, most_edits(n, similarity), items, np.array(rows))
            bit = np.uint64(1 << (at % 64))
            self.pairs[self._pair(items[:, :-1], items[:, 1:]).ravel()] |= bit
            self.lengths.append(length)
            self._plan(length)
        self.gap = max((n.words + 3 * n.edits for n in self.lengths), default=0) + 1

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _laid_out(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = items.shape[1]
        ids = np.zeros((len(items), n + 1), dtype=np.int32)
        ids[:, :n] = items
        return ids.ravel(), np.arange(len(items), dtype=np.int64) * (n + 1)

    def _plan(self, length: _Length) -> None:
        """Keys of the items for as many repetitions as the target recall asks for at the edit limit."""
        n, rng = length.words, np.random.default_rng([SEED, length.words])
        trials = 64 if length.edits else 1
        first = length.items[rng.integers(0, len(length.items), size=trials)]
        margin = length.edits
        changed = np.zeros((trials, n + 2 * margin + 1), dtype=np.int32)
        for t in range(trials):
            row = first[t].tolist()
            for _ in range(length.edits):
                at, kind = int(rng.integers(0, max(1, len(row)))), int(rng.integers(0, 3))
                if kind == 0:
                    row[at : at + 1] = [0]
                elif kind == 1:
                    row.insert(at, 0)
                else:
                    del row[at : at + 1]
            row = row[: n + margin]
            changed[t, margin : margin + len(row)] = row
        # A passage is met if a window at any start around it is; all of them are looked at.
        left, starts = self._laid_out(first)
        offsets = np.arange(trials)[:, None] * changed.shape[1] + np.arange(2 * margin + 1)
        layout, at = self._laid_out(length.items)
        repetitions = ROUND
        while True:
            walks = _Walks(n, self.samples, repetitions)
            own = walks.keys(left, starts, self.pad)
            around = walks.keys(changed.ravel(), offsets.ravel(), self.pad).reshape(repetitions, trials, -1)
            met = (around == own[:, :, None]).any(axis=2).sum(axis=0)
            # A trial's chance of never meeting, from its own rate (one that never met counts as half of a meeting).
            missed = np.power(1 - np.maximum(met, 0.5) / repetitions, repetitions)
            if not length.edits or missed.mean() <= 1 - self.recall and (met > 0).mean() >= self.recall:
                break
            if repetitions >= MOST_REPETITIONS:
                return
            repetitions += ROUND
        length.walks = walks
        for keys in walks.keys(layout, at, self.pad):
            order = np.argsort(keys, kind="stable")
            length.tables.append((keys[order], order))

    def _starts(self, size: int, hits: np.ndarray, bit: int, masks: np.ndarray, length: _Length) -> np.ndarray:
        """Every start at which a run within the edit limit of an item of this length can begin."""
        need, reach = length.words - 1 - 2 * length.edits, length.words + length.edits - 1
        if need < 1:
            return np.arange(size, dtype=np.int64)
        own = hits[(masks >> np.uint64(bit % 64)) & np.uint64(1) == 1]
        if len(own) < need:
            return np.zeros(0, dtype=np.int64)
        first, last = own[: len(own) - need + 1], own[need - 1 :]
        low = np.maximum(0, last - reach + 1)
        near = low <= first
        low, high = low[near], first[near]
        if not len(low):
            return low
        low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
        counts = np.maximum(0, high - low + 1)
        return np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """For every text, the items found in it: item_id, distance, words and at (the first word of the run's window)."""
        get = self.vocabulary.get
        coded = [np.array([get(w, 0) for w in words_of(t)], dtype=np.int32) for t in texts]
        gap = np.zeros(self.gap, dtype=np.int32)
        ids = np.concatenate([gap, *[x for c in coded for x in (c, gap)]])
        begins = np.cumsum([self.gap, *[len(c) + self.gap for c in coded]])
        masks = self.pairs[self._pair(ids[:-1], ids[1:])]
        masks[(ids[:-1] == 0) | (ids[1:] == 0)] = 0
        inside = np.concatenate([np.zeros(self.gap, bool), *[x for c in coded for x in (np.ones(len(c), bool), np.zeros(self.gap, bool))]])
        hits = np.flatnonzero(masks)
        masks = masks[hits]
        found: list[dict] = [{} for _ in texts]
        for bit, length in enumerate(self.lengths):
            starts = self._single(ids, length) if length.words == 1 else self._starts(len(ids), hits, bit, masks, length)
            starts = starts[inside[starts]]
            block = max(1, WALKS_AT_ONCE // (len(length.tables) or len(length.items)))
            for a in range(0, len(starts), block):
                self._verify(ids, begins, starts[a : a + block], length, found)
        return [[d[k] for k in sorted(d)] for d in found]

    @staticmethod
    def _single(ids: np.ndarray, length: _Length) -> np.ndarray:
        return np.flatnonzero(np.isin(ids, length.items[:, 0]))

    def _meet(self, ids: np.ndarray, starts: np.ndarray, length: _Length) -> np.ndarray:
        """Distinct (start, item) that share a key in some repetition (or all of them without walks), packed into one number."""
        if length.walks is None:
            return (starts[:, None] * len(length.items) + np.arange(len(length.items))).ravel()
        met = []
        for (keys, order), own in zip(length.tables, length.walks.keys(ids, starts, self.pad), strict=True):
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            counts = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            met.append(np.repeat(starts, counts) * len(order) + order[at])
        return np.unique(np.concatenate(met))

    def _verify(self, ids: np.ndarray, begins: np.ndarray, starts: np.ndarray, length: _Length, found: list[dict]) -> None:
        met = self._meet(ids, starts, length)
        # Starts that lie close together are looked at in one run of text that holds all their windows with the edits around them.
        at, item = np.divmod(met, len(length.items))
        doc = np.searchsorted(begins, at, "right") - 1
        stride = length.edits + 1
        close = np.unique(np.stack([doc, item, (at - begins[doc]) // stride], axis=1), axis=0)
        width = length.words + 3 * length.edits
        for a in range(0, len(close), 4096):
            doc, item, block = close[a : a + 4096].T
            begin = np.maximum(block * stride - length.edits, 0) + begins[doc]
            edits, ends = edit_distances(length.items[item], ids[begin[:, None] + np.arange(width)])
            for k in np.flatnonzero(edits <= length.edits):
                row = int(length.rows[item[k]])
                place = max(0, int(begin[k] + ends[k] - length.words - begins[doc[k]]))
                old = found[doc[k]].get(row)
                if old is None or (int(edits[k]), place) < (old["distance"], old["at"]):
                    found[doc[k]][row] = {"item_id": self.item_ids[row], "distance": int(edits[k]), "words": length.words, "at": place}


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> list[tuple[list, list[str]]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text; their number is set by the table's checked size."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        yield [r.id for r in rows], [r.text for r in rows]


MATCHES = "array<struct<item_id: bigint, distance: int, words: int, at: bigint>>"


def matches(df: DataFrame, text: Column, matcher: Matcher) -> Column:
    """The items of a block that each text holds."""
    shared = df.sparkSession.sparkContext.broadcast(matcher)

    @F.pandas_udf(MATCHES)
    def run(texts: pd.Series) -> pd.Series:
        found: list[list[dict]] = []
        part: list[str | None] = []
        size = 0
        for t in [*texts, None]:
            part.append(t)
            size += len(t or "")
            if size >= 4 << 20 or len(found) + len(part) > len(texts):
                found += shared.value.find(part)
                part, size = [], 0
        return pd.Series(found[: len(texts)])

    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, item_id, distance (word edits), words (of the item) and at (word of the document), one row per document row and item found."""
    parts = []
    for ids, texts in item_blocks(benchmark):
        found = docs.select(F.col(doc_id).alias("doc_id"), matches(docs, F.col(text), Matcher(ids, texts, **settings)).alias("found"))
        parts.append(found.where(F.size("found") > 0).select("doc_id", F.inline("found")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    for ids, texts in item_blocks(benchmark):
        docs = docs.where(F.size(matches(docs, F.col(text), Matcher(ids, texts, **settings))) == 0)
    return docs
