"""Ids of SentencePiece merge models by a table of last tokens, and the way back to text.

The encoding of a prefix of a text ends in one token only, and without that token it is the encoding of the shorter prefix: a merge run inside
the tokens before a border never sees what lies behind it. So the table of each prefix's last token is the whole encoding. It is filled from
the left: an automaton over the vocabulary names the tokens that end at a place, and the one that belongs there is the only one whose pair
with the last token before it is compatible, that is whose joint text is encoded as just these two. The ids are then read off backwards. The
work is linear in the text, however long a text without a blank is; pairs that were tested are kept in a table.

Texts are first cut at neighbours that stand side by side in no piece of the vocabulary (a letter before a blank, two digits), where a token
must end; the ids of short cuts are kept in a bounded table in every Python worker.

Defined results
* Ids equal the sentencepiece library's ``encode`` without sampling, with the end id after every text. A null or empty text has the end id alone.
* Letters outside the vocabulary are byte tokens, or the unknown id where the model has none. Text that looks like a control piece is text.
* Texts are read whole, at any length, and every row is a text of its own: ids that repeat, null ids and equal texts do no harm.
* ``encode`` replaces input columns named like its results and carries all others along. An empty table gives an empty table.
* Models other than merge models, models that rewrite texts (a character map, dropped blanks) and user-defined pieces are refused.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

from plotspark.llm.workers import kept

BLANK = "▁"
SHORT, CUTS_KEPT, PAIRS_KEPT = 64, 400_000, 500_000
ROWS_AT_ONCE = 256
NORMAL, UNKNOWN, BYTE, USER_DEFINED = 1, 2, 6, 4
_NONE = -1


class PieceModel:
    """A merge model's vocabulary with its automaton, compatible pairs and known cuts."""

    def __init__(self, path: str):
        from sentencepiece.sentencepiece_model_pb2 import ModelProto  # its classes cannot travel with a job

        proto = ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rule = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("not a plain merge model")
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER_DEFINED, 5) for p in proto.pieces):
            raise ValueError("pieces of other kinds than merged ones")
        self.library = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.prefix = BLANK if rule.add_dummy_prefix else ""
        self.end_id, self.size = self.library.eos_id(), len(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.piece_of = {i: p for p, i in normal.items()}
        unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        by_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = [by_byte.get(b, unknown) for b in range(256)] if by_byte else None
        self.unknown = unknown
        # A letter that has no piece of its own is a token that merges as any other; it is spelled out at the end.
        self.alone = sorted({c for p in normal for c in p} - normal.keys())
        self.virtual = {c: len(proto.pieces) + k for k, c in enumerate(self.alone)}
        self.piece_of |= {i: c for c, i in self.virtual.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in [*normal.items(), *self.virtual.items()]:
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.beside = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        self.one_word = all(p[1:].strip(BLANK) == p[1:] or not p.strip(BLANK) for p in normal)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by the merges themselves: the pair of best score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, token: int) -> bool:
        """Whether the text of two tokens (``_NONE``: no token before) is encoded as just these."""
        right = self.piece_of[token]
        if before == _NONE:
            fits = self.merged(right) == [right]
        else:
            left = self.piece_of[before]
            fits = self.merged(left + right) == [left, right]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[before, token] = fits
        return fits

    def last_tokens(self, text: str) -> list[tuple[int, int] | None]:
        """For every prefix of the text the (id, length) of its last token; None behind a letter that no piece holds."""
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        known = self.pairs
        for end, found in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - found[1]
                before = last[start]
                pair = (before[0] if before else _NONE, found[0])
                fits = known.get(pair)
                if self.compatible(*pair) if fits is None else fits:
                    last[end + 1] = found
        return last

    def _letter(self, letter: str) -> list[int]:
        return [self.byte_ids[b] for b in letter.encode()] if self.byte_ids else [self.unknown]

    def tokens(self, text: str) -> list[int]:
        """Ids of a cut, read backwards from the table of last tokens."""
        last, found, at = self.last_tokens(text), [], len(text)
        while at:
            here = last[at]
            if here is None or here[0] >= self.size:
                at -= 1
                found.extend(reversed(self._letter(text[at])))
            else:
                found.append(here[0])
                at -= here[1]
        return found[::-1]

    def cuts(self, text: str) -> list[str]:
        """The parts between which a token must end, whatever they hold."""
        if self.one_word and "\x00" not in text:
            # No piece has a blank behind another letter, so every blank behind one starts a new part.
            words = text.replace(BLANK, "\x00" + BLANK).split("\x00")
            parts, run = [], ""
            for word in words:
                if word == BLANK:
                    run += word
                else:
                    parts.append(run + word)
                    run = ""
            return [*parts, run] if run else parts
        return [text]

    def _part(self, text: str) -> bytes:
        if len(text) <= SHORT:
            if len(self.known) >= CUTS_KEPT:
                self.known.clear()
            ids = self.known[text] = array("i", self.tokens(text)).tobytes()
            return ids
        found, start, beside = array("i"), 0, self.beside
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in beside:
                found.extend(self.tokens(text[start:k]))
                start = k
        found.extend(self.tokens(text[start:]))
        return found.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Packed 32-bit ids of a text, the end id included."""
        end = np.array([self.end_id], dtype="<i4").tobytes()
        if not text:
            return end
        known, part = self.known.get, self._part
        return b"".join([part(c) if (ids := known(c)) is None else ids for c in self.cuts(self.prefix + text.replace(" ", BLANK))]) + end

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the library."""
        return self.library.decode(ids)


def piece_model(path: str) -> PieceModel:
    """This worker's model of a file."""
    return kept("pieces", path, PieceModel)


def encode(docs: DataFrame, model: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int, the end id last) and, if asked, ``decoded``, the text that the ids stand for."""
    added = [StructField("ids", ArrayType(IntegerType(), False), False), *([StructField("decoded", StringType(), False)] if decode else [])]
    carried = [c for c in docs.columns if c not in {f.name for f in added} or c == text]
    fields = [f for f in docs.select(*carried).schema.fields if f.name not in {a.name for a in added}]
    place = carried.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                packed = [own.encode(t) for t in rows.column(place).to_pylist()]
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                values = np.frombuffer(b"".join(packed), dtype="<i4")
                columns = [rows.column(k) for k, name in enumerate(carried) if name in {f.name for f in fields}]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                if decode:
                    columns.append(pa.array([own.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*fields, *added]])

    return docs.select(*carried).mapInArrow(run, StructType([*fields, *added]))
