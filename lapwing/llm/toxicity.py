"""Toxicity from character n-grams: a linear classifier on features scaled by naive Bayes log-count ratios.

The presence of an n-gram in a document is a feature; its value is the logarithm of the ratio of its smoothed shares in
the two classes.  A logistic regression with a penalty is fitted on the features whose ratio is best supported.
Labels come from a bounded sample of labelled rows; every document is scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.session import durable

GRAMS = (3, 4, 5, 6)
#: Bits of a hashed n-gram, features kept, labelled rows used at most, counts added to both classes.
BITS, KEPT, SAMPLE_ROWS, SMOOTHING = 20, 6000, 24_000, 1.0
PENALTY, STEPS = 0.05, 600
THRESHOLD = 0.7
_SEGMENT = 1 << 14
#: Characters whose n-grams are held at once, about 50 MB.
SLICE = 1 << 19


_WHITE = re.compile(r"\s+")


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and pieces of the lower-cased texts, about ``SLICE`` characters at a time.

    Pieces of a long text overlap, so that each of its n-grams lies in one of them.
    """
    owners: list[int] = []
    pieces: list[str] = []
    held = 0
    for owner, text in enumerate(texts):
        lowered = " " + _WHITE.sub(" ", text.lower()).strip() + " "
        for at in range(0, max(1, len(lowered) - max(GRAMS) + 1), SLICE):
            owners.append(owner)
            pieces.append(lowered[at : at + SLICE + max(GRAMS) - 1])
            held += len(pieces[-1])
            if held >= SLICE:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def hashed_grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, feature) of every n-gram of the pieces; occurrences may repeat."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(piece) for piece in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    rolled = h
    owners, features = [], []
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0xBF58476D1CE4E5B9) + h[n - 1 :]
        rolled ^= rolled >> np.uint64(31)
        if n in GRAMS:
            inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
            mixed = rolled * np.uint64(0x94D049BB133111EB)
            features.append((mixed >> np.uint64(64 - BITS)).astype(np.int32)[inside])
            owners.append(owner[: len(codes) - n + 1][inside])
    if not features:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(owners), np.concatenate(features)


def distinct_grams(texts: list[str], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of the features that each text holds, each once and in order.

    ``place`` gives the column of each feature, below 0 where it has none; without it every feature is a column.
    """
    found = [np.zeros(0, np.int64)]
    for owners, pieces in _slices(texts):
        piece, feature = hashed_grams(pieces)
        if place is not None:
            feature = place[feature]
            piece, feature = piece[feature >= 0], feature[feature >= 0]
        found.append(np.unique((np.array(owners, np.int64)[piece] << BITS) | feature))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Weight of each hashed feature (0 for most) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        place = np.where(self.weights != 0, np.arange(len(self.weights), dtype=np.int32), np.int32(-1))
        owner, feature = distinct_grams(texts, place)
        sums = np.bincount(owner, self.weights[feature], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _counts(sample: DataFrame) -> np.ndarray:
    """Documents of each class that hold each feature: added up in each task, then by segment of the features."""
    segments = (1 << BITS) // _SEGMENT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            texts, label = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
            owner, feature = distinct_grams(texts)
            for kind in (0, 1):
                table[kind] += np.bincount(feature[label[owner] == kind], minlength=1 << BITS)
        parts = table.astype("<u4").reshape(2, segments, _SEGMENT)
        filled = [s for s in range(segments) if parts[:, s].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array([parts[:, s].tobytes() for s in filled], pa.binary())],
            names=["segment", "counts"],
        )

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(2 * _SEGMENT, np.int64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts.as_buffer(), "<u4")
        return pa.table({"segment": rows["segment"][:1].cast(pa.int32()), "counts": pa.array([total.astype("<u4").tobytes()], pa.binary())})

    sums = sample.mapInArrow(work, "segment int, counts binary").groupBy("segment").applyInArrow(add, "segment int, counts binary")
    out = np.zeros((2, segments, _SEGMENT), np.int64)
    for segment, counts in sums.collect():
        out[:, segment] = np.frombuffer(bytes(counts), "<u4").reshape(2, _SEGMENT)
    return out.reshape(2, -1)


def _fit(owner: np.ndarray, values: np.ndarray, column: np.ndarray, label: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by accelerated gradient steps; rows of each class weigh by their number."""
    weights, bias = np.zeros(width), 0.0
    ahead, ahead_bias, t = weights.copy(), bias, 1.0
    row_norm = np.bincount(owner, values * values, minlength=len(label)).max(initial=0.0) + 1
    rate = 4.0 / (row_norm * len(label) + 4 * PENALTY)
    for _ in range(STEPS):
        z = np.bincount(owner, values * ahead[column], minlength=len(label)) + ahead_bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        slope = np.bincount(column, values * error[owner], minlength=width) + PENALTY * ahead
        after, after_bias = ahead - rate * slope * 8, ahead_bias - rate * error.sum() * 8
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + (t - 1) / t_next * (after - weights)
        ahead_bias = after_bias + (t - 1) / t_next * (after_bias - bias)
        weights, bias, t = after, after_bias, t_next
    return weights, bias


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_column: str = "toxic",
    id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """A model of ``label_column`` (0 or 1) from at most ``sample_rows`` labelled rows that are ``usable``.

    Rows are chosen by a hash of their id.  Rows with a null id, label or text are left out.  Without rows of both
    classes every score is the share of the class, or 0.5.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1))
    known = known if usable is None else known.where(usable)
    known = known.groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    # The parameter bounds what is broadcast here, and with it the stored sample.
    sample = durable(rows.join(F.broadcast(chosen), "__id").select("__id", "__text", "__label"))
    if sample.count() > sample_rows:
        # Ids that several documents share: the bound holds for the documents.
        sample = durable(sample.orderBy(F.xxhash64("__id", "__text"), "__id", "__text").limit(sample_rows))
    class_rows = np.zeros(2, np.int64)
    for label, n in sample.groupBy("__label").count().collect():
        class_rows[label] = n
    if not class_rows.all():
        share = (class_rows[1] + 0.5) / (class_rows.sum() + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    n0, n1 = _counts(sample)
    p0, p1 = (n0 + SMOOTHING) / (class_rows[0] + 2 * SMOOTHING), (n1 + SMOOTHING) / (class_rows[1] + 2 * SMOOTHING)
    ratio = np.log(p1 / p0)
    support = ratio / np.sqrt(1 / (n0 + SMOOTHING) + 1 / (n1 + SMOOTHING))
    best = np.argsort(-np.abs(np.where(n0 + n1 >= 3, support, 0)), kind="stable")[:KEPT]
    place = np.full(1 << BITS, -1, np.int32)
    place[best] = np.arange(len(best), dtype=np.int32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, column = distinct_grams(batch.column(1).to_pylist(), place)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([column[a:b].astype("<u2").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["id", "label", "columns"],
            )

    kind = sample.schema["__id"].dataType.simpleString()
    found = sample.mapInArrow(features, f"id {kind}, label int, columns binary").orderBy("id", "columns").collect()
    label = np.array([row["label"] for row in found], float)
    lists = [np.frombuffer(bytes(row["columns"]), "<u2") for row in found]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.concatenate(lists).astype(np.int64)
    scale = ratio[best]
    weights, bias = _fit(owner, scale[column], column, label, len(best))
    out = np.zeros(1 << BITS, np.float32)
    out[best] = weights * scale
    return Model(out, float(bias))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of each row; a null text is an empty one.  The model is one float a feature."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query."""
    scored = score(docs, train(docs, labels, ~held_out())).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
