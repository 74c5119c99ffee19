"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the commonest form.

Two such words share so much of their beginning and end that common prefix and common suffix together reach the longer
length minus one.  So they share the first half of that or the rest of it as an ending: words are dealt by both, and a
tile of words that share one is compared densely, as matrices of code points padded at the end (for prefixes) and at the
beginning (for suffixes).  A tile of too many words is cut anew by the letters it does not share yet, which ends with
words that differ in one place.  Every pair of near words comes from exactly one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.session import durable

MIN_LENGTH = 7
MIN_COUNT = 2
#: How often commoner the form of a word is.
FORM_TIMES = 10
#: Words in a tile; larger ones are cut anew.
TILE_WORDS = 96
#: Cells of a padded matrix, of words or of pairs, that are held at once.
CELLS = 1 << 20


def lower_ascii(text: Column) -> Column:
    """Only A to Z in lower case; ``lower`` does just that, and faster, to what has no other characters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def word_counts(
    docs: DataFrame, least: int = MIN_COUNT, shortest: int = MIN_LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """word, n: distinct results of the contract's runs and how often each occurs.

    A run loses a letter where 31 divides the checksum of its document and itself, which is how test texts get slips.
    """
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(
            F.regexp_extract_all(F.col(text_column), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
        ).alias("run"),
    ).withColumn("run", lower_ascii(F.col("run")))
    sums = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = sums.withColumn("at", at).select(F.when(F.col("h") % 31 == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


# -- tiles ----------------------------------------------------------------------------------------


def _halves(words: DataFrame) -> DataFrame:
    """Each word's tiles: one by beginning and one by end, among words as long and among words longer by one.

    A tile is for pairs whose longer word has ``longer`` letters; its words share the first ``head`` and the last
    ``tail``, and it answers for pairs whose common prefix is shorter than ``below``.
    """
    sized = words.withColumn("longer", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    tiles = sized.withColumns({"head": F.lit(0), "tail": F.lit(0), "below": F.col("longer")})
    return _cut(tiles)


def _cut(tiles: DataFrame) -> DataFrame:
    """Two smaller tiles for each word: pairs share a longer beginning, or else a longer end."""
    free = F.col("longer") - 1 - F.col("head") - F.col("tail")
    half = F.ceil(free / 2).cast("int")
    cut = tiles.withColumn("half", half).withColumn(
        "side",
        F.explode(
            F.array(
                F.struct(
                    (F.col("head") + F.col("half")).alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below")
                ),
                F.struct(
                    F.col("head").alias("head"), (F.col("longer") - F.col("head") - F.col("half")).alias("tail"),
                    (F.col("head") + F.col("half")).alias("below"),
                ),
            )
        ),
    )
    return cut.select("word", "n", "longer", "side.*")


def _shared() -> Column:
    """What the words of a tile share."""
    end = F.when(F.col("tail") > 0, F.expr("right(word, tail)")).otherwise(F.lit(""))
    return F.concat(F.expr("left(word, head)"), F.lit("\n"), end)


_TILE = ["longer", "head", "tail", "below", "shared"]


def _matrix(words: list[str], width: int, at_end: bool) -> np.ndarray:
    """Code points, padded with 0 at the end or at the beginning."""
    joined = "".join([word.rjust(width, "\0") if at_end else word.ljust(width, "\0") for word in words])
    try:
        cells = np.frombuffer(joined.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        cells = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    return cells.reshape(len(words), width)


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows of different words, the equal cells before the first difference."""
    return (left != right).argmax(axis=1)


def near_pairs(
    words: list[str], sizes: np.ndarray, longer: np.ndarray, below: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words in some tiles (``sizes`` words each, one after the other), each pair once.

    In a tile the longer word of a pair has ``longer`` letters and the common prefix is shorter than ``below``.  Blocks
    of rows of the padded matrices are compared with the other rows of their tiles.
    """
    width = int(longer.max())
    heads, ends = _matrix(words, width, False), _matrix(words, width, True)[:, ::-1]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tile = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    firsts = np.flatnonzero(lengths == longer[tile])
    partners = sizes[tile[firsts]]
    blocks = np.cumsum(partners) * width // CELLS
    found = []
    for block in np.split(np.arange(len(firsts)), np.flatnonzero(np.diff(blocks)) + 1):
        n = partners[block]
        one = np.repeat(firsts[block], n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[tile[one]]
        # Of two words as long, the pair counts in one direction.
        once = (lengths[other] < lengths[one]) | (one < other)
        one, other = one[once], other[once]
        prefix = _common(heads[one], heads[other])
        near = prefix + _common(ends[one], ends[other]) >= lengths[one] - 1
        near &= prefix < below[tile[one]]
        found.append((one[near], other[near]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tiles = sorted(zip(*(column.to_pylist() for column in batch.columns), strict=True), key=lambda one: one[2])
        while tiles:
            # As many tiles as fit two matrices; they are in order of their width.
            held, some = 0, 0
            for rows, _, longer, _ in tiles:
                held += len(rows)
                if some and held * longer > CELLS:
                    break
                some += 1
            now, tiles = tiles[:some], tiles[some:]
            words = [word for one in now for word in one[0]]
            ns = np.array([n for one in now for n in one[1]], np.int64)
            sizes, longer, below = (np.array(c, np.int64) for c in zip(*((len(a), c, d) for a, _, c, d in now), strict=True))
            one, other = near_pairs(words, sizes, longer, below)
            spelled = pa.array(words, pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    spelled.take(pa.array(np.concatenate([one, other]))),
                    spelled.take(pa.array(np.concatenate([other, one]))),
                    pa.array(ns[np.concatenate([other, one])]),
                ],
                names=["word", "near", "near_n"],
            )


def near_words(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """word, near, near_n: every pair of ``words`` (word, n) that differ by one letter, both ways round."""
    pairs = None
    tiles = _halves(words)
    while True:
        keyed = durable(tiles.withColumn("shared", _shared()))
        sizes = keyed.groupBy(_TILE).agg(
            F.count("*").alias("size"), F.count_if(F.length("word") == F.col("longer")).alias("longest")
        ).where((F.col("size") > 1) & (F.col("longest") > 0))
        # Tiles without letters left to cut by hold the variants of one place: as many as there are letters.
        whole = (F.col("size") <= tile_words) | (F.col("longer") - 1 == F.col("head") + F.col("tail"))
        sizes = durable(sizes.withColumn("whole", whole))
        grouped = (
            keyed.join(sizes.where("whole").select(_TILE), _TILE, "left_semi")
            .groupBy(_TILE)
            .agg(F.collect_list(F.struct("word", "n")).alias("rows"))
            .select(F.col("rows.word").alias("words"), F.col("rows.n").alias("ns"), "longer", "below")
        )
        found = grouped.mapInArrow(_compare, "word string, near string, near_n long")
        pairs = found if pairs is None else pairs.unionByName(found)
        large = sizes.where("NOT whole").select(_TILE)
        if large.isEmpty():
            return pairs
        tiles = _cut(keyed.join(large, _TILE, "left_semi").select("word", "n", "longer", "head", "tail", "below"))


# -- groups ---------------------------------------------------------------------------------------


def variant_forms(words: DataFrame, times: int = FORM_TIMES, tile_words: int = TILE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and their counts (word, n).

    ``form`` is the commonest near word (of equals the first in code-point order) where it is ``times`` as common, else
    null; ``root`` follows forms to the last.  Words without letters in common, and an empty table, give no forms.
    """
    words = durable(words)
    best = near_words(words, tile_words).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
    )
    joined = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    common = form_n >= times * F.col("n")
    formed = durable(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(common, F.col("best.form")).alias("form"), F.when(common, form_n).alias("form_n"),
        )
    )
    # A form is so many times as common that chains are short; each round follows twice as many steps.
    links = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    links = durable(links)
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = durable(links.join(step, "root", "left").select("word", "root", "further"))
        links = ahead.select("word", F.coalesce("further", "root").alias("root"))
        if ahead.where(F.col("further").isNotNull()).isEmpty():
            break
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Forms of the words of ``docs``.

    Null texts have no words, a null id counts as an empty one in the checksum, repeated rows count again; other columns
    are not read.
    """
    return variant_forms(word_counts(docs, id_column=id_column, text_column=text_column))


ORACLE_SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
    FROM documents
  ) GROUP BY ALL
), sums AS (
  SELECT run, n, xor(list_reduce(
    list_concat([4294967295], list_transform(range(0, octet_length(encode(id || ':' || run)), 1),
      lambda i: CAST(('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM runs, table_of
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM sums GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), gaps AS (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS short
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM gaps a JOIN gaps b ON a.place = b.place AND a.short = b.short AND a.word <> b.word
  UNION ALL
  SELECT DISTINCT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.short
  UNION ALL
  SELECT DISTINCT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.short
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
  FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS root, form AS further FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.further
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.further IS NULL
"""
