"""Byte-level BPE in linear time, from a file of merge ranks, and back.

A match of the splitting pattern is encoded without merging: an Aho-Corasick automaton over the tokens (bytes mapped to
Latin-1 characters) names the longest token at each place.  Tokens are chosen left to right; a token may follow another
when the merges would leave the two side by side, which is worked out once for each adjacent pair and remembered.  If no
token that fits remains, the last one is taken back and its place is marked, so each place is left at most once.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.pieces import BYTE_LEVEL, MatchCache, PieceCache

#: Matches in a generation of the encoder's cache.
KEPT_MATCHES = 80_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBpe:
    """Encoder and decoder for one set of ranks.

    ``ranks`` holds every single byte and, for every longer token, tokens of lower rank that merge into it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept_pairs: int = 120_000):
        import ahocorasick
        import regex

        self.ranks, self.kept_pairs = ranks, kept_pairs
        self.split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.halves: list[tuple[int, int]] = [(rank, rank) for rank in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: list[int] = [-1] * size
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            automaton.add_word(token.decode("latin-1"), (len(token), rank))
            for cut in range(len(token) - 1, 0, -1):
                if token[:cut] in ranks:
                    self.shorter[rank] = ranks[token[:cut]]
                    break
        automaton.make_automaton()
        self.matches = automaton.iter
        # In order of rank, so that a token's halves are found with the merges before its own.
        for rank in sorted(ranks.values()):
            token = self.token[rank]
            if len(token) > 1 and (parts := self._merge_below(token, rank)) is not None:
                self.halves[rank] = parts
                self.joined[parts] = rank

    def _merge_below(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens that are left when only merges below ``limit`` are made; None if there are more."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, place = limit, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(self.token[parts[i]] + self.token[parts[i + 1]], limit)
                if rank < best:
                    best, place = rank, i
            if place < 0:
                return None
            parts[place : place + 2] = [best]
        return parts[0], parts[1]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges of both together end with exactly these two tokens.

        The merges inside both are undone from the latest: before each, the tokens that meet at the border must not
        have been joinable by an earlier merge.
        """
        until = len(self.token)
        while True:
            joint = self.joined.get((left, right))
            if joint is not None and joint < until:
                return False
            inner, outer = self.halves[left], self.halves[right]
            whole_left, whole_right = inner[0] == left, outer[0] == right
            if whole_left and whole_right:
                return True
            if whole_right or (not whole_left and left > right):
                until, left = left, inner[1]
            else:
                # The left of two equal merges is made first: at the border the right one may still meet it.
                until, right = right + 1, outer[0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        length = len(data)
        longest = [(0, -1)] * length
        for end, found in self.matches(data.decode("latin-1")):
            start = end + 1 - found[0]
            if found > longest[start]:
                longest[start] = found
        fits, shorter, token = self.fits, self.shorter, self.token
        if len(fits) > self.kept_pairs:
            fits.clear()
        closed = bytearray(length + 1)
        out: list[int] = []
        at = 0
        nxt = longest[0][1]
        while at < length:
            last = out[-1] if out else -1
            while nxt >= 0:
                end = at + len(token[nxt])
                if not closed[end]:
                    if last < 0:
                        break
                    ok = fits.get((last, nxt))
                    if ok is None:
                        ok = fits[last, nxt] = self._stay_apart(last, nxt)
                    if ok:
                        break
                nxt = shorter[nxt]
            if nxt >= 0:
                out.append(nxt)
                at = end
                if at < length:
                    nxt = longest[at][1]
            else:
                closed[at] = 1
                nxt = out.pop()
                at -= len(token[nxt])
        return out

    def encode(self, text: str) -> list[int]:
        return [i for match in self.split(text) for i in self.encode_bytes(match.encode("utf-8"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], tuple[ByteBpe, MatchCache | PieceCache]] = {}


def codec(path: str, pattern: str) -> tuple[ByteBpe, MatchCache | PieceCache]:
    """This worker's codec; the cache gives ids as little-endian unsigned 32-bit integers."""
    if (path, pattern) not in _CODECS:
        bpe = ByteBpe(read_ranks(path), pattern)

        def one_match(part: str) -> bytes:
            return array("I", bpe.encode_bytes(part.encode("utf-8"))).tobytes()

        def encode(pieces: list[str]) -> Iterator[bytes]:
            for piece in pieces:
                yield b"".join(map(one_match, bpe.split(piece)))

        # Another pattern is matched as it stands, piece by piece.
        usual = pattern == BYTE_LEVEL
        pieces = PieceCache(encode, KEPT_MATCHES // 4 if usual else KEPT_MATCHES)
        _CODECS[path, pattern] = bpe, MatchCache(one_match, pieces.ids, KEPT_MATCHES) if usual else pieces
    return _CODECS[path, pattern]


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each row's id and ``ids``: its token ids as little-endian unsigned 32-bit integers in one binary.

    Null and empty texts have no ids.  Null and repeated row ids pass through; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = codec(ranks, pattern)
        for batch in batches:
            ids = cache.ids(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def _decoded(bpe: ByteBpe, rows: pa.RecordBatch, data: list[bytes], keep_ids: bool) -> pa.RecordBatch:
    """id, n_tokens, ids_sha256, decoded, and the ids where they are kept."""
    columns = [
        rows.column(0),
        pa.array([len(d) // 4 for d in data], pa.int64()),
        pa.array([hashlib.sha256(d).hexdigest() for d in data]),
        pa.array([bpe.decode(np.frombuffer(d, "<u4").tolist()) for d in data], pa.binary()),
    ]
    if keep_ids:
        columns.append(pa.array(data, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded", "ids"][: len(columns)])


def _decoded_schema(rows: DataFrame, keep_ids: bool) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, n_tokens long, ids_sha256 string, decoded binary" + (", ids binary" if keep_ids else "")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``id``, n_tokens, ids_sha256 and ``decoded``, the bytes of the ids, for rows of ``encode_documents``.

    With ``keep_ids`` also their ``ids``.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = codec(ranks, pattern)
        for batch in batches:
            yield _decoded(bpe, batch, [value or b"" for value in batch.column(1).to_pylist()], keep_ids)

    return encoded.mapInArrow(decode, _decoded_schema(encoded, keep_ids))


def round_trip(
    docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one worker, which holds one codec for both.

    What the codec remembers beyond its newest pieces goes when a task ends, so idle workers hold less.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = codec(ranks, pattern)
        for batch in batches:
            yield _decoded(bpe, batch, cache.ids(batch.column(1).to_pylist()), keep_ids)
        cache.shrink()

    return rows.mapInArrow(both, _decoded_schema(rows, keep_ids))
