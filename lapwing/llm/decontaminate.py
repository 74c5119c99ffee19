"""Benchmark leaks: BM25 over test items with block maxima, then overlap of question and answer.

Test items are the indexed texts and passages of the training documents are the queries: overlapping windows of words,
every one of every document.  Impacts are divided by what the item scores against itself, so one threshold serves all.
Terms are ordered by their largest impact and the pivot is where the impacts below could reach the threshold together:
only terms above it open a block of items.  A block is scored for a window when the maxima of the window's terms in the
block, with what the terms below the pivot can add to an item of it, reach the threshold; every pair above it is
retrieved.  Windows of a batch are bounded together, scoring goes window by window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.session import durable

K1, B = 1.2, 0.75
#: Words between windows; a window has twice as many, so any STRIDE words lie inside one.
STRIDE = 64
#: Items longer than this are indexed in pieces.
PIECE = 48
#: Pieces in a block, and items in one index: an index is broadcast, so its size is bounded.
BLOCK, SHARD = 2, 20_000
#: Windows times blocks whose bounds are held at once.
CELLS = 1 << 20
#: Share of the threshold that the terms below the pivot may reach together.
WEAK = 0.5
THRESHOLD = 0.5
#: Shares of the question's and of the answer's word triples that the document must hold.
QUESTION, ANSWER = 0.6, 0.5
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last line is its answer; of a single line, the last sentence; of a single sentence, its last quarter."""
    body = text.strip()
    head, mark, tail = body.rpartition("\n")
    if not mark:
        head, mark, tail = re.sub(r"([.?!])\s+", r"\1\n", body).rpartition("\n")
    first, last = words_of(head), words_of(tail)
    if not first or not last:
        every = words_of(body)
        cut = len(every) - max(1, len(every) // 4)
        first, last = every[:cut], every[cut:]
    return first, last


def triples(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


@dataclass
class Index:
    """Terms by number; impacts by piece, block maxima by term, and the items' parts for verification.

    ``row`` is the text of each piece, by place; ``keys`` and ``parts`` are the id and the parts of each text.
    """

    terms: dict[str, int]
    row: np.ndarray
    starts: np.ndarray
    piece_terms: np.ndarray
    impacts: np.ndarray
    rest: np.ndarray
    ups: np.ndarray
    up_blocks: np.ndarray
    up_values: np.ndarray
    keys: list[int]
    parts: list[tuple[set, set]]

    @property
    def blocks(self) -> int:
        return len(self.rest)


def build_index(items: list[tuple[int, str]], df: dict[str, int] | None = None, count: int | None = None) -> Index:
    """The index of ``items`` (id, text); ``df`` and ``count`` are those of all items when these are a part of them."""
    pieces: list[tuple[int, list[str]]] = []
    keys, parts = [], []
    for key, text in items:
        words = words_of(text)
        if not words:
            continue
        question, answer = question_and_answer(text)
        row = len(keys)
        keys.append(key)
        parts.append((triples(question), triples(answer)))
        n = -(-len(words) // PIECE)
        edges = np.linspace(0, len(words), n + 1).astype(int)
        pieces += [(row, words[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if df is None:
        df = Counter(w for _, text in items for w in set(words_of(text)))
        count = len(items)
    # Similar pieces share blocks, which keeps the maxima close to what one piece scores.
    pieces.sort(key=lambda p: min(((df[w], w) for w in p[1]), default=(0, "")))
    terms: dict[str, int] = {}
    average = np.mean([len(w) for _, w in pieces]) if pieces else 1.0
    numbers, impacts, starts = [], [], [0]
    for _, words in pieces:
        counts = Counter(words)
        ids = np.array([terms.setdefault(w, len(terms)) for w in counts], np.int64)
        tf = np.array(list(counts.values()), float)
        idf = np.array([np.log(1 + (count - df[w] + 0.5) / (df[w] + 0.5)) for w in counts])
        value = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
        numbers.append(ids)
        impacts.append(value / value.sum() if value.sum() > 0 else value)
        starts.append(starts[-1] + len(ids))
    piece_terms = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    impact = np.concatenate(impacts) if impacts else np.zeros(0)
    owner = np.repeat(np.arange(len(pieces)), np.diff(starts))
    blocks = -(-len(pieces) // BLOCK)
    # The pivot: the largest set of terms, weakest first, that cannot bring any item to the threshold alone.
    top = np.zeros(len(terms))
    np.maximum.at(top, piece_terms, impact)
    order = np.argsort(top, kind="stable")
    low, high = 0, len(order)
    while low < high:
        middle = (low + high + 1) // 2
        weak = np.zeros(len(terms), bool)
        weak[order[:middle]] = True
        sums = np.bincount(owner, impact * weak[piece_terms], minlength=len(pieces))
        low, high = (middle, high) if sums.max(initial=0) < THRESHOLD * WEAK else (low, middle - 1)
    weak = np.zeros(len(terms), bool)
    weak[order[:low]] = True
    below = np.bincount(owner, impact * weak[piece_terms], minlength=len(pieces))
    rest = np.zeros(blocks)
    np.maximum.at(rest, np.arange(len(pieces)) // BLOCK, below)
    strong = ~weak[piece_terms]
    cells, back = np.unique(piece_terms[strong] * max(1, blocks) + owner[strong] // BLOCK, return_inverse=True)
    values = np.zeros(len(cells))
    np.maximum.at(values, back, impact[strong])
    ups = np.searchsorted(cells, np.arange(len(terms) + 1) * max(1, blocks))
    return Index(
        terms, np.array([row for row, _ in pieces], np.int64), np.array(starts), piece_terms, impact, rest,
        ups, (cells % max(1, blocks)).astype(np.int32), values, keys, parts,
    )


def leaks_of(texts: list[str], index: Index) -> list[list[tuple[int, float, float, float]]]:
    """For each text, (item, score, question share, answer share) of every text of an item found in it."""
    out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
    if not index.blocks:
        return out
    lists = [words_of(text) for text in texts]
    sizes = np.array([len(words) for words in lists], np.int64)
    get = index.terms.get
    flat = np.array([get(word, -1) for words in lists for word in words], np.int64)
    # Halves of windows are numbered over the batch, with an empty half between documents.
    halves = sizes // STRIDE + 2
    first = np.concatenate([[0], np.cumsum(halves)])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(flat)) - np.repeat(begins[:-1], sizes)
    half = np.repeat(first[:-1], sizes) + place // STRIDE
    known = np.flatnonzero(flat >= 0)
    # One term counts once in each half.
    cell = np.unique(half[known] * len(index.terms) + flat[known])
    half_of, term = cell // len(index.terms), cell % len(index.terms)
    count = index.ups[term + 1] - index.ups[term]
    last = first[1:] - 1
    opened, block = [], []
    # Some windows at a time, so that the bounds of all blocks stay small whatever the batch and the index hold.
    step = max(1, CELLS // index.blocks)
    for low in range(0, int(first[-1]), step):
        high = min(low + step, int(first[-1]))
        a, b = np.searchsorted(half_of, [low, high + 1])
        ups = count[a:b]
        at = np.repeat(index.ups[term[a:b]] - np.concatenate([[0], np.cumsum(ups)[:-1]]), ups) + np.arange(ups.sum())
        bound = np.bincount(
            np.repeat(half_of[a:b] - low, ups) * index.blocks + index.up_blocks[at], index.up_values[at],
            minlength=(high - low + 1) * index.blocks,
        ).reshape(-1, index.blocks)
        window = bound[:-1] + bound[1:]
        # A window that begins with the empty half belongs to no document.
        window[last[slice(*np.searchsorted(last, [low, high]))] - low] = -1.0
        rows, columns = np.nonzero(window + index.rest >= THRESHOLD)
        opened.append(rows + low)
        block.append(columns)
    opened, block = np.concatenate(opened), np.concatenate(block)
    marks = np.zeros(len(index.terms), bool)
    found: dict[tuple[int, int], float] = {}
    at_window = -1
    present = np.zeros(0, np.int64)
    for w, b in zip(opened.tolist(), block.tolist(), strict=True):
        if w != at_window:
            marks[present] = False
            lo, hi = np.searchsorted(half_of, [w, w + 2])
            present, at_window = term[lo:hi], w
            marks[present] = True
        p, q = b * BLOCK, min((b + 1) * BLOCK, len(index.row))
        s, e = index.starts[p], index.starts[q]
        hit = index.impacts[s:e] * marks[index.piece_terms[s:e]]
        scores = np.add.reduceat(hit, index.starts[p:q] - s)
        doc = int(np.searchsorted(first, w, "right")) - 1
        for i in np.flatnonzero(scores >= THRESHOLD):
            pair = (doc, int(index.row[p + i]))
            found[pair] = max(found.get(pair, 0.0), float(scores[i]))
    held: dict[int, set] = {}
    for (doc, row), value in sorted(found.items()):
        if doc not in held:
            held[doc] = triples(lists[doc])
        shares = [_share(part, held[doc], lists[doc]) for part in index.parts[row]]
        if shares[0] >= QUESTION and shares[1] >= ANSWER:
            out[doc].append((index.keys[row], value, *shares))
    return out


def _share(part: set[tuple[str, ...]], held: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of a part's triples that a document holds; fewer than three words are looked for as they stand.

    The question of an item of one word has no words and counts as held.
    """
    if not part:
        return 1.0
    short = next(iter(part))
    if len(short) < 3:
        return float(any(tuple(words[i : i + len(short)]) == short for i in range(len(words) - len(short) + 1)))
    return len(part & held) / len(part)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(``id``, ``item_id``, ``score``, ``question``, ``answer``) of every leak; documents without one have no row.

    Items with a null id or no words match nothing; items with the same id are several texts of one, each of them with a
    row for a document that holds it; repeated rows of the benchmark count once.  Null and empty documents hold nothing.
    Repeated documents are repeated in the result.  Texts of items come in indexes of about ``SHARD``, each of which
    passes over the documents once; term statistics are those of all items.
    """
    items = benchmark.where(F.col(item_column).isNotNull() & F.col(item_text).isNotNull())
    items = durable(items.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("text")).distinct())
    total = items.count()
    shards = max(1, -(-total // SHARD))
    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for shard in range(shards):
        part = items.where(F.expr(f"pmod(xxhash64(item, text), {shards}) = {shard}"))
        texts = sorted((row["item"], row["text"]) for row in part.collect())
        index = build_index(texts) if shards == 1 else build_index(texts, *_statistics(items, texts))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                found = [
                    (key, *leak)
                    for key, leaks in zip(keys, leaks_of(batch.column(1).to_pylist(), shared.value), strict=True)
                    for leak in leaks
                ]
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                kinds = [batch.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["id", "item_id", "score", "question", "answer"],
                )

        found = rows.mapInArrow(work, f"id {kind}, item_id long, score double, question double, answer double")
        out = found if out is None else out.unionByName(found)
    return out


def _statistics(items: DataFrame, texts: list[tuple[int, str]]) -> tuple[dict[str, int], int]:
    """Items that hold each word of ``texts``, among all items: no more entries than the shard has words."""
    wanted = sorted({word for _, text in texts for word in words_of(text)})
    spark = items.sparkSession
    words = items.select(
        "item", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word")
    )
    known = words.join(spark.createDataFrame([(w,) for w in wanted], "word string"), "word").groupBy("word").count()
    df = dict.fromkeys(wanted, 1)
    df.update((row["word"], row["count"]) for row in known.collect())
    return df, items.count()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` without documents that hold an item; rows without an id stay."""
    leaked = find_leaks(docs, benchmark, id_column).select(F.col("id").alias("__id")).distinct()
    return docs.join(leaked, docs[id_column] == leaked["__id"], "left_anti")
