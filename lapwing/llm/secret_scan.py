"""Secrets in whole texts: keyword prefilter, anchored patterns near its hits, then embedded checksums.

An Aho-Corasick automaton finds the keywords in one pass; patterns are only tried where a keyword begins.  Runs of
hexadecimal digits have no keyword of their own letters, so the text is mapped to the class of its characters and the
keyword is a run of that class.  Kinds beyond the base ones are kept only if what they embed is right: the CRC-32 of
issued tokens, the JSON of a signed token, the length that a private key states.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# Public formats of tokens with a checksum, of signed tokens and of private keys.
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SIGNED_RUN = re.compile(rb"[A-Za-z0-9_-]+")
SIGNED = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
BLOCK = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")

#: In the order in which spans at one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "checked", "signed", "block")

_HEX_CLASS = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))
_HEX_RUN = b"h" * LEAST_HEX


def checked_token(body: bytes, check: bytes) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the ones before."""
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits == check.decode("ascii")


def _signed_token(head: bytes, claims: bytes) -> bool:
    try:
        both = [json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))) for part in (head, claims)]
    except (ValueError, binascii.Error, RecursionError):
        # Deeper than any signed token: not one.
        return False
    return all(isinstance(x, dict) for x in both) and "alg" in both[0]


def _whole_block(body: bytes) -> bool:
    try:
        data = base64.b64decode(b"".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    width = data[1] & 0x7F
    return len(data) == 2 + width + int.from_bytes(data[2 : 2 + width], "big")


_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        words = [(w, "assign") for w in ASSIGN_WORDS] + [(w, "checked") for w in CHECKED_WORDS]
        for word, kind in [*words, ("akia", "access"), ("eyj", "signed"), ("-----begin", "block")]:
            _AUTOMATON.add_word(word, (len(word), kind))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, in order of start and then of ``KINDS``; code points, end exclusive."""
    # One byte for each code point; what does not fit becomes a mark that no pattern holds.
    raw = text.encode("latin-1", "replace")
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)
    hits = sorted({(end + 1 - size, kind) for end, (size, kind) in _automaton().iter(raw.lower().decode("latin-1"))})
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(raw, start)
            good = match is not None and len(match[2]) >= LEAST_ASSIGN
        elif kind == "access":
            match = ACCESS.match(raw, start)
            good = match is not None and match.end() - start >= LEAST_ACCESS
        elif kind == "checked":
            match = CHECKED.match(raw, start)
            good = match is not None and checked_token(match[1], match[2])
        elif kind == "signed":
            match = SIGNED.match(raw, start)
            good = match is not None and _signed_token(match[1], match[2])
            if match is None:
                # What follows the run is the same for every later place in it.
                past[kind] = SIGNED_RUN.match(raw, start).end()
        else:
            match = BLOCK.match(raw, start)
            good = match is not None and _whole_block(match[2])
        if match is not None:
            past[kind] = match.end()
        if good:
            found.append((start, match.end(), kind))
    classes = raw.translate(_HEX_CLASS)
    start = classes.find(_HEX_RUN)
    while start >= 0:
        end = classes.find(b" ", start)
        end = len(classes) if end < 0 else end
        found.append((start, end, "hex"))
        start = classes.find(_HEX_RUN, end)
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``found``: a list of (kind, start, end) for each row.

    Null and empty texts have no spans.  Null and repeated ids pass through; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": kind, "start": start, "end": end} for start, end, kind in scan(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["id", "found"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def spans_text(found: F.Column) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``scan_documents``."""
    base = KINDS[:3]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(spans_text(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


def brute_base(text: str) -> list[tuple[int, int, str]]:
    """The base spans by plain patterns over the whole text, for tests."""
    raw = text.encode("latin-1", "replace")
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(rb"[0-9a-f]+", raw) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda span: (span[0], KINDS.index(span[2])))


__all__ = ["BLOCK", "KINDS", "brute_base", "checked_token", "digest", "scan", "scan_documents", "spans_text"]
