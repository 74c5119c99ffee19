"""Token ids of whole documents in patched frame-of-reference blocks.

A token file is a Parquet table with a row per chunk of documents; Spark writes and commits it, so lost tasks are
repeated safely and any shared store does.  Ranges of documents go to tasks in ascending order of id and each task
writes its own in that order.  The ids of a chunk are cut into blocks: the block's minimum is subtracted, the rest is
packed at a width that a percentile of the block decides, and ids that need more bits leave their upper bits in the
exception list.  The payload begins with an index of the blocks' starts, so that a range of ids is read alone.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.llm.pieces import MatchCache, PieceCache

BLOCK = 512
#: Ids after which a chunk of documents is closed; a longer document is a chunk of its own.
CHUNK_IDS = 1 << 17
#: Widths are taken from these percentiles of a block; the one with the smallest result is used.
PERCENTILES = (100, 99, 95, 90)
#: Matches in a generation of the encoder's cache: about 100 MB a worker.
KEPT_MATCHES = 400_000
_HEAD = np.dtype("<u4")


# -- one payload ----------------------------------------------------------------------------------


def _width(top: np.ndarray) -> np.ndarray:
    """Bits that hold each value; values are below 2^32 and floats hold them exactly."""
    return np.frexp(top.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A payload with the ids (unsigned, below 2^32)."""
    n = len(ids)
    blocks = -(-n // block)
    kind = np.dtype("<u2" if not n or int(ids.max()) < 1 << 16 else "<u4")
    table = np.empty((blocks, block), kind)
    if n:
        table.reshape(-1)[:n] = ids
        table.reshape(-1)[n:] = ids[-1]  # the filler costs no bits of its own
    low = table.min(axis=1) if n else np.zeros(0, kind)
    table -= low[:, None]
    ranks = sorted({max(0, block * p // 100 - 1) for p in PERCENTILES})
    tops = np.partition(table, ranks, axis=1)[:, ranks] if n else np.zeros((0, len(ranks)), kind)
    widths = _width(tops)
    # Outliers are those above the widest number that the width holds.
    most = ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(kind)
    over = np.stack([np.count_nonzero(table > m[:, None], axis=1) for m in most.T], axis=1) if n else np.zeros((0, 1), int)
    best = (block * widths.astype(np.int64) + 48 * over).argmin(axis=1) if n else np.zeros(0, int)
    width = widths[np.arange(blocks), best] if n else np.zeros(0, np.uint8)
    row, column = np.nonzero(table > most[np.arange(blocks), best][:, None]) if n else (np.zeros(0, int),) * 2
    upper = (table[row, column].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
    counts = np.bincount(row, minlength=blocks).astype("<u2")
    sizes = (width.astype(np.int64) * block + 7) // 8 + 6 * counts.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w in (8, 16, 32):
            rows = table[which].astype(f"<u{w // 8}").view(np.uint8)
        else:
            bits = np.unpackbits(table[which].view(np.uint8).reshape(len(which), block, -1), axis=2, bitorder="little")
            rows = np.packbits(bits[:, :, :w].reshape(len(which), -1), axis=1, bitorder="little")
        for index, data in zip(which, rows, strict=True):
            packed[index] = data.tobytes()
    spots, tails = column.astype("<u2"), upper
    ends = np.cumsum(counts.astype(np.int64))
    body = [
        packed[i] + spots[e - c : e].tobytes() + tails[e - c : e].tobytes()
        for i, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True))
    ]
    head = np.array([n, block], _HEAD).tobytes()
    index = low.astype("<u4").tobytes() + width.tobytes() + counts.tobytes() + starts.tobytes()
    return head + index + b"".join(body)


def unpack(payload: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from ``begin`` to before ``end``; only their blocks are decoded."""
    n, block = (int(x) for x in np.frombuffer(payload, _HEAD, 2))
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, "<u4")
    blocks = -(-n // block)
    at = 8
    low = np.frombuffer(payload, "<u4", blocks, at)
    width = np.frombuffer(payload, np.uint8, blocks, at := at + 4 * blocks)
    counts = np.frombuffer(payload, "<u2", blocks, at := at + blocks)
    starts = np.frombuffer(payload, "<u4", blocks + 1, at := at + 2 * blocks)
    body = at + 4 * (blocks + 1)
    first, last = begin // block, (end - 1) // block + 1
    out = np.zeros((last - first, block), "<u4")
    chosen = np.arange(first, last)
    for w in np.unique(width[first:last]):
        which = chosen[width[first:last] == w]
        size = (int(w) * block + 7) // 8
        if not size:
            continue
        raw = np.stack([np.frombuffer(payload, np.uint8, size, body + int(starts[i])) for i in which])
        if w in (8, 16, 32):
            out[which - first] = raw.view(f"<u{w // 8}")
            continue
        bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : int(w) * block].reshape(len(which), block, int(w))
        wide = np.zeros((len(which), block, 32), np.uint8)
        wide[:, :, : int(w)] = bits
        out[which - first] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i in chosen[counts[first:last] > 0]:
        spot = body + int(starts[i]) + (int(width[i]) * block + 7) // 8
        places = np.frombuffer(payload, "<u2", int(counts[i]), spot)
        tails = np.frombuffer(payload, "<u4", int(counts[i]), spot + 2 * int(counts[i]))
        out[i - first, places] |= tails << np.uint32(width[i])
    out += low[first:last, None]
    return out.reshape(-1)[begin - first * block : end - first * block]


# -- tokenizer ------------------------------------------------------------------------------------

_ENCODERS: dict[str, MatchCache] = {}

#: The characters that byte-level vocabularies write for bytes.
_SIGNS = list(map(chr, range(256)))
for _sign, _byte in enumerate([*range(33), *range(127, 161), 173], 256):
    _SIGNS[_byte] = chr(_sign)


def _visible(part: str) -> str:
    """What byte-level vocabularies write for the bytes of a match."""
    body = part[1:] if part[0] == " " else part
    if body.isascii() and body.isalnum():
        return part if body is part else _SIGNS[32] + body
    return "".join([_SIGNS[byte] for byte in part.encode("utf-8")])


def encoder(path: str) -> MatchCache:
    """This worker's encoder for the tokenizers file; ids come as little-endian unsigned 32-bit integers."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            kinds = json.load(file)
        splitter = kinds.get("pre_tokenizer") or {}
        bytewise = kinds.get("normalizer") is None and splitter.get("type") == "ByteLevel"
        if not (bytewise and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")):
            raise ValueError(f"{path} is not a byte-level tokenizer without normalizer")

        # White space that a piece seldom holds: between two pieces it is an id of its own.
        (between,) = tokenizer.encode("\x0b", add_special_tokens=False).ids
        merge = tokenizer.model.tokenize

        def one_match(part: str) -> bytes:
            return array("I", [token.id for token in merge(_visible(part))]).tobytes()

        def plain(pieces: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
            return [array("I", one.ids).tobytes() for one in found]

        def encode(pieces: list[str]) -> list[bytes]:
            # A piece with its own space can follow the mark, one that ends in white space would swallow the next.
            joined, alone = [], []
            for i, piece in enumerate(pieces):
                fits = piece[:1] == " " and not piece[-1].isspace() and "\x0b" not in piece
                (joined if fits else alone).append(i)
            out: list[bytes] = [b""] * len(pieces)
            for i, ids in zip(alone, plain([pieces[i] for i in alone]), strict=True):
                out[i] = ids
            for at in range(0, len(joined), 64):
                some = joined[at : at + 64]
                text = "\x0b".join([pieces[i] for i in some])
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                marks = (4 * np.flatnonzero(ids == between)).tolist()
                data = ids.tobytes()
                for i, a, b in zip(some, [0, *(m + 4 for m in marks)], [*marks, len(data)], strict=True):
                    out[i] = data[a:b]
            return out

        pieces = PieceCache(encode, KEPT_MATCHES // 8)
        cache = MatchCache(one_match, pieces.ids, KEPT_MATCHES)
        whole = cache.ids
        # Marks of the tokenizer written in a text are ids of their own and end what stands before them.
        marks = [token["content"] for token in kinds.get("added_tokens") or []]
        marked = re.compile("|".join(map(re.escape, marks))) if marks else None

        def ids(texts: list[str]) -> list[bytes]:
            odd = [i for i, text in enumerate(texts) if marked and marked.search(text)]
            if not odd:
                return whole(texts)
            at = set(odd)
            out = dict(zip(odd, plain([texts[i] for i in odd]), strict=True))
            rest = [i for i in range(len(texts)) if i not in at]
            out.update(zip(rest, whole([texts[i] for i in rest]), strict=True))
            return [out[i] for i in range(len(texts))]

        cache.ids = ids
        _ENCODERS[path] = cache
    return _ENCODERS[path]


# -- operator -------------------------------------------------------------------------------------


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write the token file of ``docs`` to ``path``.

    Null and empty texts are one end id; rows with a null or repeated id are written like others, nulls first and
    repeated ids in order of text.  An empty table gives a file without chunks.  Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    kind = rows.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("chunk", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        data: list[bytes] = []
        held = 0
        id_type = None

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()),
                    pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(id_type)),
                    pa.array([[len(d) // 4 for d in data]], pa.list_(pa.int32())),
                    pa.array([pack(ids)], pa.binary()),
                ],
                names=["part", "chunk", "start", "n_ids", "ids", "counts", "payload"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), work.ids(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                data.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= CHUNK_IDS:
                    yield row()
                    chunk, start, keys, data, held = chunk + 1, start + held, [], [], 0
        if keys:
            yield row()

    rows.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of a token file: id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: before it in its chunk, in the task's earlier chunks, and in
    earlier tasks.  The last is a running sum over one row a task.
    """
    file = spark.read.parquet(path)
    kind = file.schema["ids"].dataType.elementType
    sums = file.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("id", kind),
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, keys, counts, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack(payload).astype("<u4").tobytes()
                ends = np.cumsum([0, *counts])
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(keys), pa.int32()),
                        pa.array(keys, batch.column(2).type.value_type),
                        pa.array(start + ends[:-1], pa.int64()),
                        pa.array(counts, pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["part", "id", "at", "n_tokens", "ids_crc32"],
                )

    rows = file.select("part", "start", "ids", "counts", "payload").mapInArrow(decode, schema)
    joined = rows.join(base, "part")
    return joined.select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
