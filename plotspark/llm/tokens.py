"""Token ids of whole texts by the tokenizers library, each different word encoded once per task.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids are those of the whole text; texts in which that is not
certain, or that hold a special token's text, are encoded whole. Words of Latin letters go straight to the tokenizer's merge model, all else through the whole tokenizer. The ids
of the pieces are kept in a bounded table in every Python worker, which outlives its tasks until it is let go (``forget``).
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

from plotspark.llm.workers import dropped, kept

#: Pieces of at most so many characters are kept, so the table's bytes are bounded too, in two generations of so many. From 349,526 entries on
#: a dict takes twice the room.
SHORT, PIECES_KEPT = 64, 349_000

_DOUBLE_SPACE = re.compile(r"\s\s")
_SEPARATOR_CONTROLS = re.compile("[\x1c-\x1f]")
#: Letters whose lower case and composed form are the same everywhere: Latin without the dotted capital I.
_LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
#: A word, then signs that are neither letters, digits nor white space: always two tokens' runs or more.
_WORD_AND_SIGNS = re.compile(f"( ?[{_LATIN}]+)([^\\s\\w]*)")
_PROBES = ("word", " word", "\u00c9t\u00e9", " stra\u00dfe", "a", " ma\u00f1ana")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


class Encoder:
    """``words``: the tokenizer drops white space and cuts words at it; otherwise a word keeps the one space before it.

    ``special``: a special token's text becomes its id, as by the library's default; otherwise it is text like any other.
    """

    def __init__(self, path: str, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) if special else []
        self.words = self._ids(" a b") == self._ids("a\nb")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        letters = byte_letters()
        spelled = [32, *[c for c in range(0x250) if chr(c).isalpha()]]
        self.spelling = {c: "".join(letters[b] for b in chr(c).encode()) for c in spelled}
        self.direct = all(self._merged(p) == self._packed(self._ids(p)) for p in _PROBES if not (self.words and p[0] == " "))
        self.pieces: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _merged(self, word: str) -> bytes:
        """Ids of a word of Latin letters, by the merge model alone."""
        if self.words:
            word = word.lower()
        return self._packed([t.id for t in self.tokenizer.model.tokenize(word.translate(self.spelling))])

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where it is not certain that the tokenizer cuts between them."""
        if self.words:
            return None if _SEPARATOR_CONTROLS.search(text) else text.split()
        return None if _DOUBLE_SPACE.search(text) or "\x00" in text else text.replace(" ", "\x00 ").split("\x00")

    def _part(self, part: str) -> bytes:
        """Ids of a piece without line breaks between words."""
        found = _WORD_AND_SIGNS.fullmatch(part) if self.direct else None
        # A combining mark among the signs may belong to the word's last letter.
        if found is None or not unicodedata.is_normalized("NFC", part):
            return self._packed(self._ids(part))
        word, signs = found.groups()
        ids = self.pieces.get(word) or self.older.get(word)
        if ids is None:
            ids = self._keep(word, self._merged(word))
        if not signs:
            return ids
        after = self.pieces.get(signs) or self.older.get(signs)
        if after is None:
            after = self._keep(signs, self._packed(self._ids(signs)))
        return ids + after

    def _learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is not None:
            self.pieces[piece] = ids
            return ids
        lines = [piece] if self.words or "\n" not in piece else piece.split("\n")
        if len(lines) == 1:
            ids = self._part(piece)
        else:
            ids = self._packed(self._ids("\n")).join([self._part(line) if line else b"" for line in lines])
        return self._keep(piece, ids)

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= SHORT:
            self.pieces[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian ids of each text (null: none)."""
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        if len(self.pieces) > PIECES_KEPT:
            # What is still in use moves over from the older generation when it is met again.
            self.pieces, self.older = {"": b""}, self.pieces
        cut = None if any(t in text for t in self.special) else self._cut(text)
        if cut is None:
            return self._packed(self._ids(text))
        known, learn = self.pieces.get, self._learn
        return b"".join([learn(p) if (ids := known(p)) is None else ids for p in cut])


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file; its ids are the library's, special tokens included."""
    return kept("tokens", path, lambda file: Encoder(file, special=True))


def forget() -> None:
    """Give this worker's encoders and their tables back, once a job has all its ids: an idle worker would hold them through later jobs."""
    dropped("tokens")
