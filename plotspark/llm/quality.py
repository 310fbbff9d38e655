"""Quality rules on whole texts: counting rules, then the distance of a text's distributions from its language's.

Every text gets a histogram of character classes and one of its language's most common words. Both are compared with the pooled histogram of
all texts of that language by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Texts too short for a histogram
to mean anything are not judged by it. Everything is built-in functions, row by row; only word counts and one row per language are shuffled.

Defined results
* A null text is an empty text: no words, so it fails the counting rules. A row with a null language bends no reference and is judged by the
  nearest one: the language with the least word distance, then class distance.
* Words are runs of characters other than space and \\x09-\\x0D; texts are read whole, at any length.
* Every row is judged by itself, so repeated rows and repeated or null ids each keep their own verdict. An empty table gives an empty table.
* The text and language columns are read by name; all other columns are carried along unless they bear the name of a result column,
  which then replaces them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotspark.llm.small import BROADCAST_ROWS, settled

SPACE = r"[\x20\x09-\x0D]"
#: Character classes in the order in which they are taken out of a text; what is left after the last is "other".
CLASSES = (("lower", r"\p{Ll}"), ("space", SPACE), ("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"), ("symbol", r"[#*$%&|<>]"), ("punct", r"\p{P}"))
STRATUM_BYTES = 64
FEW_REPEATS = 64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 32
    #: A histogram is judged from this many characters or words on.
    min_class_chars: int = 200
    min_common_words: int = 100
    max_class_distance: float = 0.27
    max_word_distance: float = 0.33
    min_reference_bytes: int = 300
    #: Strata of text length over which a language's reference is averaged.
    strata: int = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more (windows are told apart by 64-bit digests)."""
    size = F.size(words)
    digests = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(starts: Column) -> Column:
        return _let(starts, lambda s: F.size(F.array_union(F.array_union(s, F.transform(s, lambda x: x + 1)), F.transform(s, lambda x: x + 2))))

    def in_order(all_digests: Column) -> Column:
        """Starts of repeated windows from the sorted windows; for texts with very many different ones."""
        same = lambda ordered, x, i: F.coalesce(F.get(ordered, i)["digest"] == x["digest"], F.lit(False))
        pairs = F.sort_array(F.transform(all_digests, lambda x, i: F.struct(x.alias("digest"), i.alias("at"))))
        return _let(pairs, lambda o: F.transform(F.filter(o, lambda x, i: same(o, x, i - 1) | same(o, x, i + 1)), lambda x: x["at"]))

    def starts(all_digests: Column, again: Column) -> Column:
        few = F.filter(F.sequence(F.lit(0), F.size(all_digests) - 1), lambda i: F.array_contains(again, F.get(all_digests, i)))
        return F.when(F.size(again) <= FEW_REPEATS, few).otherwise(in_order(all_digests))

    def counted(all_digests: Column) -> Column:
        again = _let(F.sort_array(all_digests), lambda o: F.array_distinct(F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1) == x, F.lit(False)))))
        some = _let(again, lambda found: covered(starts(all_digests, found)))
        return F.when(F.size(F.array_distinct(all_digests)) == F.size(all_digests), 0).otherwise(some)

    return F.when(size >= 3, _let(digests, counted)).otherwise(0)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def with_class_counts(df: DataFrame, text: str = "__text") -> DataFrame:
    """``df`` with ``__classes``, the characters of each class and at last all others, from ever shorter rests of the text."""
    counts, rest = [], F.col(text)
    for name, pattern in CLASSES:
        df = df.withColumn(f"__no_{name}", F.regexp_replace(rest, f"{pattern}+", ""))
        counts.append(F.length(rest) - F.length(f"__no_{name}"))
        rest = F.col(f"__no_{name}")
    counts.append(F.length(rest))
    return df.withColumn("__classes", F.array(*[c.cast("bigint") for c in counts])).drop(*[f"__no_{name}" for name, _ in CLASSES])


def language_references(texts: DataFrame, rules: QualityRules) -> DataFrame:
    """__lang, __top (its most common words), __word_share (theirs and all others'), __class_share; over all texts of min_reference_bytes or more.

    Counts are taken per byte within strata of text length and averaged over a language's strata: copies of one text, however many, lie in
    one stratum (near copies in few) and cannot bend the reference to themselves.
    """
    size = F.octet_length("__text")
    sized = texts.where(size >= rules.min_reference_bytes).withColumn("__stratum", F.pmod(F.floor(size / STRATUM_BYTES), F.lit(rules.strata)).cast("int"))
    groups = ["__lang", "__stratum"]
    class_sums = [F.sum(F.col("__classes")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums = settled(with_class_counts(sized).groupBy(*groups).agg(F.sum(size).alias("bytes"), *class_sums))
    all_chars = sum((F.col(f"c{i}") for i in range(len(CLASSES) + 1)), F.lit(0))
    classes = sums.groupBy("__lang").agg(F.array(*[F.avg(F.col(f"c{i}") / all_chars) for i in range(len(CLASSES) + 1)]).alias("__class_share"))
    weighed = sized.join(sums.select(*groups, (1 / F.col("bytes")).alias("weight")), groups)
    words = weighed.select("__lang", "weight", F.explode(words_of(F.col("__text"))).alias("word"))
    weights = words.groupBy("__lang", "word").agg(F.sum("weight").alias("weight"))
    # A row per language; where the sums by language and stratum were small enough to be broadcast, so is this.
    totals = weights.groupBy("__lang").agg(F.sum("weight").alias("all"))
    totals = F.broadcast(totals) if sums.count() <= BROADCAST_ROWS else totals
    shares = weights.join(totals, "__lang").select("__lang", "word", F.round(F.col("weight") / F.col("all"), 12).alias("share"))
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("share"), "word"))
    top = shares.withColumn("rank", rank).where(F.col("rank") <= rules.common_words)
    top = top.groupBy("__lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "share"))).alias("top"))
    common = F.transform("top", lambda x: x["share"])
    return top.join(classes, "__lang").select(
        "__lang", F.transform("top", lambda x: x["word"]).alias("__top"), F.concat(common, F.array(F.greatest(1 - _total(common), F.lit(0.0)))).alias("__word_share"), "__class_share",
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _let(total, lambda t: F.transform(counts, lambda x: x / F.greatest(t, F.lit(1).cast("bigint"))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = _total(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _common_shares(spaced: Column, n_words: Column, top: Column) -> Column:
    """Shares of the common words among a text's words, and at last of all others; every word of ``spaced`` has a space on each side."""
    size = F.octet_length(spaced)
    count = lambda w: (size - F.octet_length(F.replace(spaced, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)
    total = F.greatest(n_words, F.lit(1))
    shares = F.transform(top, lambda w: count(w) / total)
    return _let(shares, lambda own: F.concat(own, F.array(F.greatest(1 - _total(own), F.lit(0.0)))))


def judge(docs: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept.

    A distance is null where the text is too short for it or where its language has no reference, and then rejects nothing.
    """
    rules = rules or QualityRules()
    marked = docs.withColumns({"__text": F.coalesce(F.col(text), F.lit("")), "__lang": F.col(lang)})
    references = settled(language_references(marked.where("__lang IS NOT NULL").select("__text", "__lang"), rules))
    # A row's references: its language's, or all of them (a row per language) where it has none.
    reference = F.struct("__top", "__word_share", "__class_share")
    every = references.agg(F.collect_list(reference).alias("__references")).select(F.lit(None).cast("string").alias("__lang"), "__references")
    own = settled(references.select("__lang", F.array(reference).alias("__references")).unionAll(every))
    rows = with_class_counts(marked.join(own.withColumnRenamed("__lang", "__of"), F.col("__lang").eqNullSafe(F.col("__of")), "left").drop("__of"))

    spaced = F.concat(F.lit(" "), F.regexp_replace("__text", SPACE + "+", "  "), F.lit(" "))
    rows = rows.withColumn("__words", _let(words_of(F.col("__text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).cast("bigint").alias("repeats"))))
    chars = F.length("__text").cast("bigint")
    class_shares = _shares(F.col("__classes"))
    judged_words, judged_classes = F.col("__words.n") >= rules.min_common_words, chars >= rules.min_class_chars

    def distances(t: Column, c: Column, r: Column) -> Column:
        by_word = F.when(judged_words, js_distance(_common_shares(t, F.col("__words.n"), r["__top"]), r["__word_share"]))
        return F.struct(by_word.alias("word"), F.when(judged_classes, js_distance(c, r["__class_share"])).alias("class"))

    nearest = _let(spaced, lambda t: _let(class_shares, lambda c: F.array_min(F.transform("__references", lambda r: distances(t, c, r)))))
    rows = rows.withColumn("__nearest", nearest)
    rows = rows.withColumns({
        "n_words": F.col("__words.n"),
        "word_chars": chars - F.col("__classes")[1],
        "n_symbols": F.col("__classes")[4],
        "n_dup_lines": dup_lines(F.col("__text")).cast("bigint"),
        "n_repeat_words": F.col("__words.repeats"),
        "class_distance": F.col("__nearest.class"),
        "word_distance": F.col("__nearest.word"),
    })
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
    return rows.drop("__text", "__lang", "__words", "__classes", "__references", "__nearest")


def keep(docs: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # The filter mentions a row number, so that Spark filters after the counts instead of working them out at every mention of one.
    judged = judge(rows, rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).select("__doc.*")
