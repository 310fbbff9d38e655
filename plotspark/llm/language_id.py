"""Language identification by compression: the language whose dictionary compresses a text best.

For every labelled language a bounded sample of text becomes a raw-content zstandard dictionary. A text is cut into blocks, each block is
compressed with every dictionary, and the language with the smallest sum is chosen. Where the second best is nearly as small, the choice is
marked as rejected. The model is the only thing gathered; prediction is a map over rows, and whole texts are read.

The sample: ``samples`` cells per language by the digest of the text, in each cell the text with the smallest digest, and of it at most
``sample_chars`` characters from a place that the digest sets. Copies of a text share a cell, so they fill one sample however many they are.

Defined results
* Texts that are null or have no letter are ``und`` with score 0, and so are all texts where no labelled text was given.
* Rows with a null language or text teach nothing. Every row is predicted by its text alone, so repeated rows get the same answer.
* Of equal sums the language with more labelled texts wins (then the alphabetically first), with score 0. With one language only, the score is 1.
* An empty table gives an empty table. Result columns replace input columns of the same name; all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.llm.small import settled

UNKNOWN = "und"
SAMPLES = 256
SAMPLE_CHARS = 1024
MOST_LANGUAGES = 1000
LEVEL = 3
BLOCK_BYTES = 4096
#: Below this relative margin between the best and the second best sum a choice is rejected.
MIN_MARGIN = 0.02
#: From this margin on the score is 1.
SURE_MARGIN = 0.5
PREDICTION = "lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Languages, those with more labelled texts first, and their dictionaries."""

    languages: list[str]
    dictionaries: list[bytes]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.dictionaries:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", samples: int = SAMPLES, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """A model of the languages of ``labelled``, from at most ``samples`` pieces of ``sample_chars`` characters of each."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("cell", F.pmod("digest", F.lit(samples)))
    chosen = settled(rows.groupBy("lang", "cell").agg(F.min("digest").alias("digest")))
    place = F.pmod(F.shiftrightunsigned("digest", 16), F.greatest(F.length("text") - sample_chars, F.lit(1))).cast("int") + 1
    piece = F.substr("text", place, F.lit(sample_chars))
    found = rows.join(chosen, ["lang", "cell", "digest"]).select("lang", "cell", piece.alias("piece")).groupBy("lang", "cell").agg(F.min("piece").alias("piece"))
    languages: dict[str, list[str]] = {}
    for row in found.orderBy("lang", "cell").toLocalIterator():
        languages.setdefault(row.lang, []).append(row.piece)
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()} if languages else {}
    names = sorted(languages, key=lambda n: (-counts[n], n))
    return LanguageModel(names, ["\n".join(languages[n]).lower().encode() for n in names])


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of a whole text under every dictionary."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors])


def predict(text: Column, model: LanguageModel, min_margin: float = MIN_MARGIN) -> Column:
    """Struct of lang_pred, score (0 to 1), margin and rejected for every text."""

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for batch in batches:
            rows = []
            for value in batch:
                if value is None or not compressors:
                    rows.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                own = sizes(value, compressors)
                order = np.argsort(own, kind="stable")
                margin = float(own[order[1]] / own[order[0]] - 1) if len(own) > 1 else SURE_MARGIN
                rows.append((model.languages[order[0]], min(1.0, margin / SURE_MARGIN), margin, margin < min_margin))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])

    return run(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected."""
    found = docs.withColumn("__found", predict(F.col(text), model, min_margin))
    names = ("lang_pred", "score", "margin", "rejected")
    return found.withColumns({n: F.col(f"__found.{n}") for n in names}).drop("__found")
