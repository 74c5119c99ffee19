"""Packing documents into windows of token ids with next to no padding.

Documents are encoded once and stored with their ids.  Whole windows of a document are sequences of their own; what is
left of each, its rest, is shorter than a window.  Combinations of up to three lengths that fill a window exactly are
enumerated, and non-negative least squares finds how often to use each so that together they come close to the counts of
the rests' lengths.  The repeat counts are rounded, then what they leave is packed greedily, longest first, and a rest
is cut where nothing else fills a window.  The last, unfilled sequence is cut at powers of two, which need no padding.

Only the counts of lengths (fewer than the window has places) reach the driver.  A plan names, for each length, which
ranks go to which sequences; rests are ranked within their length by running counts of the stored parts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.llm.token_blocks import encoder
from lapwing.session import durable

WINDOW = 1024
#: Steps of the least-squares solver; what it leaves unsolved is packed greedily.
STEPS = 400

#: A row of a plan: rests of ``length`` with ranks from ``lo`` to before ``hi`` place ``size`` of their ids, from
#: ``begin`` on, at ``offset`` of the sequences from ``sequence`` on, one each.
PLAN = np.dtype([(name, "<i8") for name in ("length", "lo", "hi", "begin", "size", "sequence", "offset")])


# -- the plan -------------------------------------------------------------------------------------


def combinations(window: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and how often each is used: up to three a combination, the sum is the window (0 fills unused places).

    Two lengths, three lengths, and one length repeated with another that fills up.
    """
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    first, second = np.meshgrid(lengths, lengths, indexing="ij")
    third = window - first - second
    fits = (first <= second) & (second <= third) & here[np.maximum(third, 0)]
    triples = np.stack([first[fits], second[fits], third[fits]], axis=1)
    once = np.ones_like(triples)
    pairs = lengths[(2 * lengths <= window) & here[window - lengths]]
    pairs = np.stack([pairs, window - pairs, 0 * pairs], axis=1)
    used, times = [triples, pairs], [once, np.repeat([[1, 1, 0]], len(pairs), axis=0)]
    repeats = [
        (length, window - k * length, k)
        for length in lengths.tolist()
        for k in range(3, window // length + 1)
        if window - k * length != length and here[window - k * length] | (window == k * length)
    ]
    if repeats:
        several = np.array(repeats)
        used.append(np.stack([several[:, 0], several[:, 1], 0 * several[:, 0]], axis=1))
        times.append(np.stack([several[:, 2], (several[:, 1] > 0).astype(int), 0 * several[:, 0]], axis=1))
    return np.concatenate(used).astype(np.int64), np.concatenate(times).astype(np.int64)


def repeat_counts(used: np.ndarray, times: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each combination: non-negative least squares against ``counts`` (by length).

    Accelerated projected gradients over the three entries of each column, columns scaled to length 1.
    """
    if not len(used):
        return np.zeros(0)
    # Equal lengths of one combination are one entry of the column.
    weight = times.astype(float)
    weight[:, 0] += np.where(used[:, 1] == used[:, 0], weight[:, 1], 0) + np.where(used[:, 2] == used[:, 0], weight[:, 2], 0)
    second = np.where(used[:, 1] == used[:, 0], 0, weight[:, 1])
    weight[:, 1] = second + np.where((used[:, 2] == used[:, 1]) & (used[:, 1] != used[:, 0]), weight[:, 2], 0)
    weight[:, 2] = np.where((used[:, 2] == used[:, 0]) | (used[:, 2] == used[:, 1]), 0, weight[:, 2])
    weight[used == 0] = 0
    norm = np.sqrt((weight**2).sum(axis=1))
    weight /= norm[:, None]
    places = used.reshape(-1)

    def forth(x: np.ndarray) -> np.ndarray:
        return np.bincount(places, (weight * x[:, None]).reshape(-1), len(counts))

    def back(r: np.ndarray) -> np.ndarray:
        return (weight * r[used]).sum(axis=1)

    probe = np.ones(len(used))
    for _ in range(20):
        probe = back(forth(probe))
        size = np.linalg.norm(probe)
        probe /= size
    step = 1 / (1.05 * size)
    x = ahead = np.zeros(len(used))
    pace = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - step * back(forth(ahead) - counts))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - x)
        x, pace = new, faster
    return x / norm


class _Rests:
    """Ranks of rests not yet placed, by the length that is left of them."""

    def __init__(self, counts: dict[int, int]):
        self.ranges: dict[int, deque] = defaultdict(deque)
        self.left: dict[int, int] = defaultdict(int)
        for length, n in counts.items():
            self.give(length, (length, 0, n, 0))

    def give(self, length: int, ranks: tuple[int, int, int, int]) -> None:
        if length and ranks[2] > ranks[1]:
            self.ranges[length].append(ranks)
            self.left[length] += ranks[2] - ranks[1]

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.left[length] -= n
        ranges = self.ranges[length]
        while n:
            whole, lo, hi, begin = ranges.popleft()
            if hi - lo > n:
                ranges.appendleft((whole, lo + n, hi, begin))
                hi = lo + n
            n -= hi - lo
            yield whole, lo, hi, begin


def plan_rests(counts: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int, int]:
    """The plan for rests counted by length (1 to window - 1), its number of sequences, and how many of those the
    least-squares counts gave.

    Every id of every rest is placed once; all sequences have ``window`` ids except powers of two at the end.
    """
    counts = {int(length): int(n) for length, n in counts.items() if length and n}
    rests = _Rests(counts)
    rows: list[tuple] = []
    sequences = 0

    def place(slots: list[tuple[int, int]], times: int) -> None:
        """``slots`` are lengths with the part of each that is used (its first ids), ``times`` the sequences."""
        nonlocal sequences
        offset = 0
        for length, size in slots:
            at = sequences
            for whole, lo, hi, begin in list(rests.take(length, times)):
                rows.append((whole, lo, hi, begin, size, at, offset))
                at += hi - lo
                rests.give(length - size, (whole, lo, hi, begin + size))
            offset += size
        sequences += times

    if counts:
        used, times = combinations(window, np.array(sorted(counts)))
        have = np.zeros(window + 1)
        for length, n in counts.items():
            have[length] = n
        solved = repeat_counts(used, times, have)
        for i in np.argsort(-solved, kind="stable"):
            wanted = int(solved[i] + 0.5)
            if not wanted:
                break
            need: dict[int, int] = defaultdict(int)
            for length, k in zip(used[i].tolist(), times[i].tolist(), strict=True):
                if k:
                    need[length] += k
            wanted = min(wanted, *(rests.left[length] // k for length, k in need.items()))
            if wanted:
                place([(length, length) for length, k in need.items() for _ in range(k)], wanted)
    solved_sequences = sequences

    while True:
        lengths = sorted((length for length, n in rests.left.items() if n), reverse=True)
        if not lengths:
            break
        slots, need, space = [], defaultdict(int), window
        for length in lengths:
            k = min(space // length, rests.left[length])
            if k:
                slots += [(length, length)] * k
                need[length] = k
                space -= k * length
        if space:
            cut = next((length for length in lengths if rests.left[length] > need[length]), None)
            if cut is None:
                break
            slots.append((cut, space))
            need[cut] += 1
        place(slots, min(rests.left[length] // k for length, k in need.items()))
    # All that is left is one sequence that ends early: cut it where its parts are powers of two.
    last = sum(length * n for length, n in rests.left.items())
    parts = [1 << bit for bit in range(window.bit_length() - 1, -1, -1) if last >> bit & 1]
    for part in parts:
        slots, space = [], part
        need = defaultdict(int)
        for length in sorted((length for length, n in rests.left.items() if n), reverse=True):
            while space and rests.left[length] > need[length]:
                size = min(space, length)
                slots.append((length, size))
                need[length] += 1
                space -= size
        place(slots, 1)
    plan = np.array(rows, PLAN) if rows else np.zeros(0, PLAN)
    return np.sort(plan, order=["length", "begin", "lo"]), sequences, solved_sequences


# -- the operator ---------------------------------------------------------------------------------


def encode_rests(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, n_ids, ids, and where each stands among the rows of its task: part, rest, rank (among rests of that length)
    and windows (whole ones before it)."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n_ids", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("rest", T.IntegerType()),
            T.StructField("rank", T.LongType()),
            T.StructField("windows", T.LongType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen, windows = [0] * window, 0
        for batch in batches:
            data = [ids + end for ids in work.ids(batch.column(1).to_pylist())]
            sizes = [len(d) // 4 for d in data]
            rests, ranks, before = [], [], []
            for size in sizes:
                rest = size % window
                rests.append(rest)
                ranks.append(seen[rest])
                before.append(windows)
                seen[rest] += 1
                windows += size // window
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()),
                    pa.array([part] * len(data), pa.int32()), pa.array(rests, pa.int32()),
                    pa.array(ranks, pa.int64()), pa.array(before, pa.int64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(encode, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, keep_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """A row per piece: id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``keep_ids`` the piece's ``ids`` as little-endian unsigned 32-bit integers.

    ``window`` is a power of two.  Null and empty texts are one end id.  Null and repeated ids pass through, each row
    is packed.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    stored = durable(encode_rests(docs, tokenizer, end_id, window, id_column, text_column))
    # A row per part and length of rest: far smaller than the documents, and the length alone has few values.
    tally = durable(
        stored.groupBy("part", "rest").agg(
            F.count("*").alias("n"), F.sum(F.expr(f"n_ids div {window}")).alias("windows")
        )
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tally.groupBy("part").agg(F.sum("windows").alias("windows")).select(
        "part", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("windows_before")
    )
    ranked = tally.select(
        "part", "rest", F.coalesce(F.sum("n").over(before.partitionBy("rest")), F.lit(0)).alias("ranks_before")
    )
    base = durable(ranked.join(parts, "part"))
    counts = {row["rest"]: row["n"] for row in tally.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan, sequences, _ = plan_rests(counts, window)
    starts = np.searchsorted(plan["length"], np.arange(window + 1))

    placed = stored.join(base, ["part", "rest"]).select(
        "id", "n_ids", "ids", "rest",
        (F.col("rank") + F.col("ranks_before")).alias("rank"),
        (F.col("windows") + F.col("windows_before") + F.lit(sequences)).alias("sequence"),
    )
    schema = T.StructType(
        [
            T.StructField("id", stored.schema["id"].dataType),
            *(T.StructField(name, T.LongType()) for name in (
                "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
            *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which: list[int] = []
            out: list[tuple[int, ...]] = []
            pieces: list[bytes] = []

            def ready() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True))
                arrays = [batch.column(0).take(pa.array(which)), *(pa.array(c, pa.int64()) for c in columns)]
                if keep_ids:
                    arrays.append(pa.array(pieces, pa.binary()))
                return pa.RecordBatch.from_arrays(arrays, names=schema.names)

            values = [column.to_pylist() for column in batch.columns[1:]]
            for row, (n, data, rest, rank, sequence) in enumerate(zip(*values, strict=True)):
                whole = n // window * window
                spots = [(at, window, sequence + at // window, 0) for at in range(0, whole, window)]
                if rest:
                    ours = plan[starts[rest] : starts[rest + 1]]
                    ours = ours[(ours["lo"] <= rank) & (rank < ours["hi"])]
                    spots += [
                        (whole + begin, size, first + rank - lo, offset)
                        for _, lo, _, begin, size, first, offset in ours.tolist()
                    ]
                for begin, size, place, offset in spots:
                    piece = data[4 * begin : 4 * (begin + size)]
                    which.append(row)
                    out.append((begin, size, zlib.crc32(piece), n, place, offset))
                    if keep_ids:
                        pieces.append(piece)
                if len(out) >= 4096:
                    yield ready()
                    which, out, pieces = [], [], []
            if out:
                yield ready()

    return placed.mapInArrow(cut, schema)
