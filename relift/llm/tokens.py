"""Token ids of whole texts by a public tokenizer file.

The file's pre-tokenizer never matches white space, so ids of a text are those of its parts between
blanks, one after another.  Each Python worker keeps the ids of parts that it has met, up to a bound.
A new part of plain Latin letters, digits and signs goes to the library's BPE model piece by piece, as
the file's pre-tokenizer splits it; any other part goes through the library's whole pipeline.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: The tokenizer's file, as the public_tokenizers package names it.
WORD_BPE = "word_bpe_49k.json"
#: Parts that a worker keeps; beyond, it starts anew.
KEPT_PARTS = 300_000
#: Parts whose normalised form is their lower case, and how the file splits those.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_HELD: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def _byte_chars() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Parts(dict):
    """The ids, as bytes, of each part; a new part's are found on first use."""

    def __init__(self, tokenizer, plain: bool):
        super().__init__({"": b""})
        self.tokenizer, self.plain, self.pieces, self.chars = tokenizer, plain, {}, _byte_chars()

    def _piece(self, piece: str) -> bytes:
        as_bytes = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)
        self.pieces[piece] = found = array("I", [t.id for t in self.tokenizer.model.tokenize(as_bytes)]).tobytes()
        return found

    def __missing__(self, part: str) -> bytes:
        known, piece = self.pieces.get, self._piece
        low = part.lower()
        if self.plain and part.isascii() and part.isalpha():
            found = known(low) or piece(low)
        elif self.plain and part.isascii() and part[:-1].isalpha() and part[-1] in ".,!?;:":
            found = (known(low[:-1]) or piece(low[:-1])) + (known(low[-1]) or piece(low[-1]))
        elif self.plain and PLAIN(part) and "<|" not in part:
            found = b"".join([known(x) or piece(x) for x in PIECES(low)])
        else:
            found = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        self[part] = found
        return found

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.clear()
            self.pieces.clear()
            self[""] = b""


class Encoder:
    """``encode(texts, end)`` gives one uint32 array a text, the id ``end`` appended; NULL is empty text."""

    def __init__(self, path: str | None = None, kept: int = KEPT_PARTS):
        from tokenizers import Tokenizer

        # another file may split and normalise otherwise: its parts go through its whole pipeline
        self.parts = Parts(Tokenizer.from_file(path or default_path()), (path or default_path()) == default_path())
        self.kept = kept

    @classmethod
    def held(cls, path: str | None = None) -> Encoder:
        """The worker's encoder for this file, with the parts it has kept from earlier tasks."""
        if (path or "") not in _HELD:
            _HELD[path or ""] = cls(path)
        return _HELD[path or ""]

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        last, get, out = array("I", [end]).tobytes(), self.parts.__getitem__, []
        for text in texts:
            self.parts.trim(self.kept)
            out.append(np.frombuffer(b"".join(map(get, (text or "").replace("\n", " ").split(" "))) + last, np.uint32))
        return out
