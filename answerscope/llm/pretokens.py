"""Splitting a text into pieces whose encodings are independent, with a bounded cache.

The patterns in ``PIECEWISE`` attach one space to the front of the word that
follows it.  In a text whose white space is single spaces and single line
breaks only, every such place is a pre-token boundary, so the text may be cut
there and each piece encoded on its own; encodings of frequent pieces are then
looked up.  Any other text (runs of white space, tabs, white space at an end)
is encoded as one piece, and so is every text under any other pattern.  Either
way the result is the plain encoding.
"""

from __future__ import annotations

from collections.abc import Callable


#: Pre-token patterns under which a text may be cut before single spaces and line breaks.
PIECEWISE = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


class Cache(dict):
    """piece -> encoding, computed on first use.  ``trim`` empties it when it has grown past ``limit`` entries."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str):
        out = self[piece] = self.make(piece)
        return out

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


class Splitter:
    """``split(text)``: the encodings of the pieces of ``text``, in order.  ``encode``: of any string on its own."""

    def __init__(self, encode: Callable, limit: int = 300_000, piecewise: bool = True):
        self.encode, self.piecewise = encode, piecewise
        self.cache = Cache(lambda c: encode(self.whole(c)), limit)

    @staticmethod
    def whole(piece: str) -> str:
        """A piece stands for itself after a line break, and for itself with a space in front otherwise."""
        return piece if piece[0] == "\n" else " " + piece

    def _plain(self, text: str) -> bool:
        return self.piecewise and bool(text) and " ".join(text.split()) == text.replace("\n", " ")

    def missing(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """What ``split`` of ``texts`` would have to encode: pieces to put into the cache, and strings that stand for themselves."""
        self.cache.trim()
        pieces: set[str] = set()
        alone = []
        for t in texts:
            if self._plain(t):
                own = t.replace("\n", " \n").split(" ")
                alone.append(own[0])
                pieces.update(own)
            elif t:
                alone.append(t)
        return list(pieces.difference(self.cache)), alone

    def split(self, text: str) -> list:
        if not self._plain(text):
            return [self.encode(text)] if text else []
        pieces = text.replace("\n", " \n").split(" ")
        out = list(map(self.cache.__getitem__, pieces))
        out[0] = self.encode(pieces[0])
        return out
