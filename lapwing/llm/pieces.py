"""Cutting a text where the byte-level pre-tokenizer cuts it anyway.

Texts of Latin letters are cut into the matches of its pattern, which need no tables of other scripts.  Other texts are
cut at spaces, and the libraries know the rest.

The pattern of the byte-level tokenizers attaches one space to what follows it, so a space before a character that
is not white space always begins a new match, and the match before it never looks past that space in a way that
changes it: its only look-ahead asks whether a run of white space is followed by something else, and leaves exactly
one space to the next match.  Encoding such pieces one by one therefore gives the ids of the whole text, and
pieces, mostly words, repeat: their ids are looked up rather than worked out again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?!\S)")
_MARKS = re.compile(r"([^\w\s]+)\Z")

#: Pieces longer than this are never kept; the rest of the cache is bounded by its entries.
KEPT_LENGTH = 64

# Fixed value: the pattern of byte-level tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Letters, numbers and white space of the pattern below U+0250, where every version of the tables agrees,
# and the punctuation and currency signs of the ranges beside.
_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_SPACES = "\\t-\\r \\x85\\xa0"
_FOREIGN = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20b0]")
#: The pattern's matches in a text of those characters.  No letter or number begins like a contraction, so it stands first.
_MATCHES = re.compile(
    f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def cut(text: str) -> list[str]:
    """The pieces; every one but the first stands for itself with one space before it."""
    return text.split(" ") if _RUN.search(text) is None else _CUT.split(text)


def _places_of_none(values: list) -> list[int]:
    out: list[int] = []
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class MatchCache:
    """Ids of whole texts as bytes, from a function that encodes one match of the byte-level pattern.

    Texts of Latin letters are cut into matches here; others go to ``rest``, texts to ids.  Matches are kept in two
    generations of ``limit`` entries: when the young one is full it becomes the old one, and what is still used moves on.
    A worker's memory is bounded whatever it reads.
    """

    def __init__(self, encode: Callable[[str], bytes], rest: Callable[[list[str]], list[bytes]], limit: int):
        self.encode, self.rest, self.limit = encode, rest, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def shrink(self) -> None:
        """Forget all but the young generation."""
        self.old = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old, encode = self.young, self.old, self.encode
        get, cut = young.get, _MATCHES.findall
        out: list[bytes] = [b""] * len(texts)
        foreign = [i for i, text in enumerate(texts) if not text.isascii() and _FOREIGN.search(text)]
        for i, ids in zip(foreign, self.rest([texts[i] for i in foreign]) if foreign else [], strict=True):
            out[i] = ids
        elsewhere = set(foreign)
        for i, text in enumerate(texts):
            if i in elsewhere:
                continue
            parts = cut(text)
            got = list(map(get, parts))
            for place in _places_of_none(got):
                part = parts[place]
                ids = young.get(part)
                if ids is None:
                    ids = old.get(part) or encode(part)
                    if len(part) <= KEPT_LENGTH:
                        young[part] = ids
                got[place] = ids
            out[i] = b"".join(got)
        return out


class PieceCache:
    """Ids of whole texts as bytes, from a function that encodes missing pieces.

    ``encode`` gets pieces (with their space) and returns one ``bytes`` each.  Pieces are kept in two generations of
    ``limit`` entries: when the young one is full it becomes the old one, and what is still used moves on.  A
    worker's memory is bounded whatever it reads.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 150_000):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def shrink(self) -> None:
        """Forget all but the young generation."""
        self.old = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        cuts = [cut(text) for text in texts]
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        get = young.get
        got = [list(map(get, parts)) for parts in cuts]
        holes = [_places_of_none(ids_of) for ids_of in got]
        new = {parts[i] for parts, gaps in zip(cuts, holes, strict=True) for i in gaps}
        for piece in new:
            if piece in old:
                young[piece] = old[piece]
        missing = new.difference(old)
        # Letters with marks after them are two matches of the pattern: the letters are often known.
        ends = {
            piece: m.start()
            for piece in missing
            if not piece[-1:].isalnum() and (m := _MARKS.search(piece)) and piece[: m.start()].isalpha()
        }
        whole = list(missing.difference(ends))
        stems = {piece[:end] for piece, end in ends.items()}.difference(young, whole)
        for stem in stems:
            if stem in old:
                young[stem] = old[stem]
        whole.extend(stems.difference(old))
        young.update(zip(whole, self.encode([" " + piece for piece in whole]), strict=True))
        for piece, end in ends.items():
            marks = piece[end:]
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                (self.marks[marks],) = self.encode([marks])
            young[piece] = young[piece[:end]] + self.marks[marks]
        heads = [parts[0] for parts in cuts]
        out = []
        for head, parts, ids_of, gaps in zip(self.encode(heads), cuts, got, holes, strict=True):
            for i in gaps:
                ids_of[i] = young[parts[i]]
            ids_of[0] = head
            out.append(b"".join(ids_of))
        for piece in [*missing, *stems]:
            if len(piece) > KEPT_LENGTH:
                young.pop(piece, None)
        return out
