"""Secrets in texts: values after telling names and random tokens, and a random forest that sorts out the false findings.

Every candidate is described by its length, the kinds of characters and how often they change, how much of it is made of dictionary words,
whether it looks like a path or address, and by the words before it. A random forest is fitted on labelled findings, a bounded sample of
``train_rows`` a class, and decides on every candidate. Half of the sample has its neighbouring words blanked, so that the forest learns what
a secret looks like and not only what is written before one. Dictionary counts cover all texts.

Defined results
* A candidate is the value after a telling name and ``= : := =>`` (name and value quoted or not), of any length and with any signs; a run of 12
  or more of ``A-Z a-z 0-9 + / _ . @ -`` (and closing ``=``) with a digit; or a run of 20 or more letters and ``+ / _ -`` without one whose case
  changes often or that has few vowels. A quoted value ends at its quote, another at white space. Whole texts are searched, at any length.
* Null and empty texts have no candidates. Copies of a text have the same findings each; in the sample equal candidates count once.
* Where the labelled findings lack a class, no forest is fitted and the labels themselves decide; findings without a label are then no secrets.
* Rows are known by their text alone, so null and repeated ids do no harm. Empty tables give no findings.
* Result columns replace input columns of the same name; ``redact`` carries all others along and replaces text and n_chars where it cuts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.llm.small import settled
from plotspark.session import checkpointed

TRAIN_ROWS = 10_000
TREES, DEPTH, SEED = 32, 8, 7
MIN_SCORE = 0.5
MIN_WORD_COUNT = 3
MASK = "[SECRET]"
#: Words that announce a secret, wherever they stand in the name before it.
_HINT = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or(?!i[sz])))"
_HINTED = re.compile(_HINT, re.I)
#: Runs without a digit are candidates if their case changes at this share of places, or if fewer of their letters are vowels.
MIN_CASE_CHANGES, MIN_VOWELS = 0.3, 0.24
#: Paths whose kinds of characters change this often, as a whole or in a piece of 16 or more, are not taken for harmless.
MIN_RANDOM_CHANGES = 0.35

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*[0-9])[A-Za-z0-9+/_.@-]{12,}={0,2}")
_NO_DIGIT = re.compile(r"(?<![A-Za-z0-9+/_.@-])[A-Za-z+/_-]{20,}={0,2}(?![A-Za-z0-9+/_.@-])")
_QUOTED = "|".join(rf"{q}((?:[^{q}\\\n]|\\.)+){q}(?!\w)" for q in "\"'`")
_SCHEME = r"(?:(?:[Bb]earer|[Bb]asic|[Tt]oken)\s+)?"
_VALUE = re.compile(rf"(?i:{_HINT})[\w-]{{0,64}}[\"'`]?[ \t]*(?:=>|:=|==?|:(?!:))(?:\s*{_SCHEME}(?:{_QUOTED})|[ \t]*{_SCHEME}[\"'`]?([^\s\"'`]+))")
_CLOSING = ".,;:!?)]}>"
_NAME_BEFORE = re.compile(rf"([A-Za-z_][\w-]*)[\"'`]?\s*(=>|:=|==?|:)\s*{_SCHEME}[\"'`]?$")
_WORD = re.compile(r"[^\W\d_]{2,}")
_SHAPED = {
    "mail": re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+\.?"),
    "address": re.compile(r"(\d{1,3}\.){3}\d{1,3}\.?"),
    "number": re.compile(r"[0-9+/_.@-]+"),
}
NUMBERS = (
    "length", "digit_share", "upper_share", "sign_share", "change_share", "letter_digit_share", "piece_change", "vowel_share", "entropy", "distinct_share", "path_signs", "like_mail", "like_number",
    "coverage", "named", "hinted", "hint_near", "quoted",
)
NEIGHBOURS = ("named", "hinted", "hint_near", "quoted")
_FOUND = ", ".join(["at: int", "candidate: string", "name: string", "kind: string", "runs: array<string>", *[f"{n}: double" for n in NUMBERS if n != "coverage"]])
FINDINGS = f"array<struct<{_FOUND}>>"


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _changes(kinds: list[int]) -> float:
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)


def _vowels(found: str) -> float:
    return sum(c in "aeiouyAEIOUY" for c in found) / max(1, sum(c.isalpha() for c in found))


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate, in order; the value after a telling name comes before a run that overlaps it."""
    found = []
    for m in _VALUE.finditer(text):
        at = m.lastindex
        start, end = m.span(at)
        while at == 4 and end > start and text[end - 1] in _CLOSING:
            end -= 1
        if end > start:
            found.append((start, end))
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    for m in _NO_DIGIT.finditer(text):
        if _changes([_kind(c) for c in m[0] if c.isalpha()]) >= MIN_CASE_CHANGES or _vowels(m[0]) < MIN_VOWELS:
            runs.append(m.span())
    if found and runs:
        taken = iter([*found, (len(text) + 1, len(text) + 1)])
        low, high = next(taken)
        for start, end in sorted(runs):
            while high <= start:
                low, high = next(taken)
            if end <= low:
                found.append((start, end))
        return sorted(found)
    return sorted(found or runs)


def describe(text: str, start: int, end: int) -> dict:
    """Everything that is known of a candidate without the dictionary."""
    found = text[start:end]
    before = text[max(0, start - 128) : start]
    named = _NAME_BEFORE.search(before)
    name = named.group(1).lower() if named else ""
    kinds = [_kind(c) for c in found]
    pairs = list(zip(kinds, kinds[1:], strict=False))
    pieces = [[_kind(c) for c in p] for p in re.split(r"[/._@-]+", found) if len(p) >= 16]
    counts = Counter(found)
    size = len(found)
    shape = next((k for k, p in _SHAPED.items() if p.fullmatch(found)), "path" if "/" in found[1:] else "token")
    near = " ".join(_WORD.findall(before.lower())[-3:])
    return {
        "at": start, "candidate": found, "name": name, "kind": shape, "runs": [r.lower() for r in re.findall(r"[A-Za-z]{3,}", found)],
        "length": float(size), "digit_share": kinds.count(2) / size, "upper_share": kinds.count(1) / size, "sign_share": kinds.count(3) / size,
        "change_share": sum(a != b for a, b in pairs) / max(1, len(pairs)), "letter_digit_share": sum((a < 2) != (b < 2) and 3 not in (a, b) for a, b in pairs) / max(1, len(pairs)),
        "piece_change": max(map(_changes, pieces), default=0.0), "vowel_share": _vowels(found), "entropy": -sum(n / size * math.log2(n / size) for n in counts.values()), "distinct_share": len(counts) / size, "path_signs": float(sum(found.count(c) for c in "/.@")),
        "like_mail": float(shape == "mail"), "like_number": float(shape in ("number", "address")), "named": float(bool(name)),
        "hinted": float(bool(_HINTED.search(name))), "hint_near": float(bool(_HINTED.search(near))), "quoted": float(before[-1:] in ("'", '"', "`") and before != ""),
    }


def candidates(text: Column) -> Column:
    """All candidates of a text with their descriptions."""

    @F.pandas_udf(FINDINGS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[describe(t, start, end) for start, end in spans(t)] if t else [] for t in texts])

    return run(text)


def _known_by(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_digest"), F.hash(text).alias("text_hash")]


def scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: text_digest and text_hash of its text, the ``carry`` columns, its place, name, kind and numbers (with coverage)."""
    rows = docs.select(*carry, *_known_by(F.col(text)), candidates(F.col(text)).alias("found")).where(F.size("found") > 0)
    found = checkpointed(rows.select("text_digest", "text_hash", *carry, F.inline("found")))
    return with_coverage(found, dictionary(docs, found, text))


def dictionary(docs: DataFrame, found: DataFrame, text: str = "text", min_count: int = MIN_WORD_COUNT) -> DataFrame:
    """Which of the candidates' letter runs are words: those that stand alone in the texts ``min_count`` times or more."""
    runs = settled(found.select(F.explode("runs").alias("word")).distinct())
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")).alias("word"))
    # Counted before the join, so that no run, however common a word, meets more than one row.
    counted = words.select(F.rtrim("word", F.lit(".,;:!?")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return settled(counted.join(runs, "word").select("word"))


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the share of each candidate's characters that lie in words."""
    key = ["text_digest", "text_hash", "at"]
    parts = found.select(*key, F.explode("runs").alias("word")).join(words, "word")
    # Copies of a text bring the same parts; one of each place is enough.
    covered = parts.groupBy(*key, "word").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.sum(F.length("word")).alias("letters"))
    joined = found.join(covered, key, "left")
    return joined.withColumn("coverage", F.least(F.coalesce(F.col("letters"), F.lit(0)) / F.col("length"), F.lit(1.0))).drop("letters", "runs")


def rule_labels(found: DataFrame) -> DataFrame:
    """``found`` with a label where a plain rule is sure: 1 for a token under a telling name, 0 for mail addresses, numbers, plain paths and prose.

    Random paths without a name, quoted words and numbers under a telling name stay without a label.
    """
    hinted = F.col("hinted") == 1
    secret = hinted & F.col("kind").isin("token", "path") & (F.col("coverage") < 0.5)
    plain = (F.col("change_share") < MIN_RANDOM_CHANGES) & (F.col("piece_change") < MIN_RANDOM_CHANGES)
    unnamed = ~hinted & (((F.col("kind") == "path") & plain) | (F.col("coverage") >= 0.5))
    harmless = F.col("kind").isin("mail", "address") | (~hinted & (F.col("kind") == "number")) | unnamed
    # A lower-case or capitalised word with an ordinary share of vowels, however rare.
    wordlike = (F.col("digit_share") + F.col("sign_share") == 0) & (F.col("upper_share") * F.col("length") <= 1) & (F.col("vowel_share") >= MIN_VOWELS)
    prose = hinted & (F.col("quoted") == 0) & ((F.col("coverage") >= 1) | wordlike)
    secret = secret & ~wordlike
    return found.withColumn("label", F.when(secret, 1.0).when(harmless | prose, 0.0))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> PipelineModel | None:
    """A forest fitted on at most ``train_rows`` labelled findings of each class, or None if one class is missing."""
    # Of equal candidates the one with the smallest numbers stands for all, whatever the shuffle.
    rows = labelled.where("label is not null").groupBy("candidate", "name", "label").agg(F.min(F.struct(*NUMBERS)).alias("__numbers"))
    rows = rows.select("candidate", "name", "label", "__numbers.*").withColumn("order", F.xxhash64("candidate", "name", "label"))
    parts = [rows.where(F.col("label") == value).orderBy("order", "candidate", "name").limit(train_rows) for value in (0.0, 1.0)]
    sample = checkpointed(parts[0].unionAll(parts[1]))
    if len(sample.groupBy("label").count().collect()) < 2:
        return None
    blank = F.pmod("order", F.lit(2)) == 0
    sample = sample.withColumns({n: F.when(blank, 0.0).otherwise(F.col(n)) for n in NEIGHBOURS})
    features = VectorAssembler(inputCols=list(NUMBERS), outputCol="__features")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="__chances", rawPredictionCol="__votes", predictionCol="__class")
    return PipelineModel([features, forest.fit(features.transform(sample))])


def classify(found: DataFrame, model: PipelineModel | None, min_score: float = MIN_SCORE) -> DataFrame:
    """``found`` with score and is_secret."""
    if model is None:
        scored = rule_labels(found).withColumn("score", F.coalesce("label", F.lit(0.0))).drop("label")
    else:
        scored = model.transform(found).withColumn("score", vector_to_array("__chances")[1]).drop("__features", "__chances", "__votes", "__class")
    return scored.withColumn("is_secret", F.col("score") >= min_score)


def scan_and_classify(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """All candidates of ``docs`` with score and is_secret, by a forest fitted on the findings that plain rules label."""
    found = checkpointed(scan(docs, text, carry))
    return classify(found, train(rule_labels(found)))


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mask``, and n_chars, if there is such a column, set to the new length."""
    found = scan_and_classify(docs, text).where("is_secret")
    spans = found.select("text_digest", "text_hash", F.col("at"), F.col("length").cast("int").alias("size")).distinct()
    per_text = spans.groupBy("text_digest", "text_hash").agg(F.sort_array(F.collect_list(F.struct("at", "size")), asc=False).alias("__spans"))
    per_text = settled(per_text.withColumnsRenamed({"text_digest": "__digest", "text_hash": "__hash"}))
    known = dict(zip(("__digest", "__hash"), _known_by(F.col(text)), strict=True))
    rows = docs.withColumns(known).join(per_text, ["__digest", "__hash"], "left")
    cut = F.aggregate("__spans", F.col(text), lambda t, s: F.overlay(t, F.lit(mask), s["at"] + 1, s["size"]))
    rows = rows.withColumn(text, F.when(F.col("__spans").isNotNull(), cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
