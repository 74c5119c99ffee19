"""Phrase collocations by relational mining of occurrences.

Every occurrence of a word is a row (doc, place, word), stored bucketed and sorted by document; the end of a piece takes a
place too, so words of two pieces are never next to each other.  Occurrences join those of the adjacent place of the same
document: a merge join of two stored relations that are dealt and sorted alike, so rows neither move nor are sorted anew.
The joined phrases are grouped and counted; only occurrences of phrases that are frequent go on (a semi-join), and join
those that overlap with all but their first word.

Words have 64-bit keys, as they are spelled, until frequent ones are numbered (the key's seed is changed until no two
spellings share one); spellings that differ in A-Z alone are one word and get one number.  Frequent phrases are numbered
too, so a longer phrase is the number of what it starts with and that of what it ends with.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.spelling import lower_ascii
from lapwing.operators.scan import position, scan, series
from lapwing.session import durable, shared_path

#: Fixed values of the contract: what ends a piece, and words of a piece.
PIECE_END = r"[.,;:!?\x0A\x0B\x0C\x0D]"
WORD = r"[^\x20\x09.,;:!?\x0A\x0B\x0C\x0D]+"

MIN_COUNT = 10
LONGEST = 3
TOP = 2000
#: Percent of a candidate's occurrences that lie inside one longer candidate and make it go.
INSIDE_PERCENT = 50
#: Frequent groups are broadcast to filter occurrences up to this many (two long numbers each); beyond it they are dealt.
BROADCAST_GROUPS = 2_000_000
#: Rows of a chunk where groups are numbered.
CHUNK_ROWS = 200_000
LOW_BITS = (1 << 32) - 1
#: What the session is set to while occurrences are joined.
SETTINGS = {
    # Relations dealt by document alone are joined by document and place as they are, and buckets are read in their order.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # A stored table needs no shuffle files once it is written.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def texts_of(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """lang, doc (a number of its own) and text of every row; null languages are ``und``."""
    return docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.monotonically_increasing_id().alias("doc"),
        F.col(text_column).alias("text"),
    )


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))


def _words_and_ends(text: str = "text") -> Column:
    """Words in their order, and an empty one wherever pieces end between them."""
    return F.regexp_extract_all(F.col(text), F.lit(f"({WORD})|{PIECE_END}+"), F.lit(1))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("lang"), F.col("spelled"))


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """lang, spelled, word (A-Z in lower case), n and word_key of every spelling, and the seed that gives no key twice."""
    spoken = texts.select("lang", F.explode(_words()).alias("spelled"))
    counted = durable(spoken.groupBy("lang", "spelled").agg(F.count("*").alias("n")))
    seed = 0
    while True:
        keyed = counted.withColumn("word_key", _key(seed))
        totals = keyed.agg(F.count("*").alias("words"), F.count_distinct("word_key").alias("keys")).first()
        if totals["words"] == totals["keys"]:
            return keyed.withColumn("word", lower_ascii(F.col("spelled"))), seed
        seed += 1


class _Occurrences:
    """Relations (doc, place, after, id), each written bucketed by document and sorted by document and place.

    ``after`` is the place after ``place``, so the files are sorted by document and ``after`` as well.
    """

    def __init__(self, texts: DataFrame):
        self.spark = texts.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def deal(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "doc")

    def store(self, relation: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The stored relation as (doc, place, id), and as (doc, after, id): two tables over the same files."""
        by_place, by_after = (f"lapwing_occurrences_{uuid.uuid4().hex}" for _ in range(2))
        path = shared_path(self.spark, "occurrences")
        writer = relation.withColumn("after", F.col("place") + 1).write.format("parquet").option("compression", "zstd")
        # Sorted numbers compress as they are; looking each up in a dictionary costs more than it saves.
        writer = writer.option("parquet.enable.dictionary", "false")
        writer = writer.bucketBy(self.buckets, "doc").sortBy("doc", "place")
        writer.option("path", path).saveAsTable(by_place)
        self.names.append(by_place)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.table(by_place).schema)
        self.spark.sql(
            f"CREATE TABLE {by_after} ({columns}) USING parquet "
            f"CLUSTERED BY (doc) SORTED BY (doc, after) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        self.names.append(by_after)
        return self.spark.table(by_place).select("doc", "place", "id"), self.spark.table(by_after).select("doc", "after", "id")

    def forget(self) -> None:
        """Take the tables out of the catalog."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


def _numbered(groups: DataFrame, key: str) -> DataFrame:
    """``groups`` with a dense ``id`` from 0, in the order of a key that is spread evenly or of its hash."""
    spread = groups.withColumn("__h", F.xxhash64(key))
    return scan(spread, series((), ("__h", key), CHUNK_ROWS), id=position()).withColumn("id", F.col("id") - 1).drop("__h")


def _only(rows: DataFrame, frequent: DataFrame, key: str, tables: _Occurrences) -> DataFrame:
    """Rows of frequent groups with the groups' ids, dealt by document."""
    groups = frequent.select(key, "id")
    if frequent.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key).drop(key)
    return tables.deal(rows.join(groups, key).drop(key))


def phrase_counts(texts: DataFrame, seed: int, common: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """For each length from 2 on: the phrases found at least ``least`` times, as (id, first, last, a): the ids of the
    phrase without its last word and without its first word, and the count.

    ``common`` holds word_key and id of the spellings of words found as often; the parts of a frequent phrase are frequent.
    A phrase's place is that of its last word.
    """
    spark = texts.sparkSession
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    tables = _Occurrences(texts)
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        spoken = tables.deal(texts).select("lang", "doc", F.posexplode(_words_and_ends()).alias("place", "spelled"))
        keyed = spoken.where("spelled <> ''").select("doc", "place", _key(seed).alias("word_key"))
        stored, counts = tables.store(_only(keyed, common, "word_key", tables)), []
        for length in range(2, longest + 1):
            ends, starts = stored
            starts = starts.select("doc", F.col("after").alias("place"), "id")
            joined = starts.hint("merge").join(ends.withColumnRenamed("id", "last"), ["doc", "place"])
            # Both ids are below 2^32.
            grown = joined.select("doc", "place", F.shiftleft("id", 32).bitwiseOR(F.col("last")).alias("both"))
            frequent = durable(grown.groupBy("both").agg(F.count("*").alias("a")).where(F.col("a") >= least))
            frequent = durable(_numbered(frequent, "both"))
            counts.append(
                frequent.select(
                    "id", F.shiftrightunsigned("both", 32).alias("first"), F.col("both").bitwiseAND(F.lit(LOW_BITS)).alias("last"), "a"
                )
            )
            if length < longest:
                stored = tables.store(_only(grown, frequent, "both", tables))
        return counts
    finally:
        tables.forget()
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _spelled(common: DataFrame, counts: list[DataFrame]) -> list[DataFrame]:
    """Each length's phrases with the ids of their words (w1 ... wk) and their count; single words first."""
    out = [common.select("id", F.col("id").alias("w1"), "a")]
    for length, frequent in enumerate(counts, 2):
        shorter = _keys(length - 1)
        starts = out[-1].select(F.col("id").alias("first"), *shorter)
        ends = out[-1].select(F.col("id").alias("last"), F.col(shorter[-1]).alias(f"w{length}"))
        out.append(frequent.join(starts, "first").join(ends, "last").select("id", *_keys(length), "a"))
    return [durable(phrases.drop("id")) for phrases in out]


def _keys(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits; exact for counts below 10^16."""
    wide = [c.cast("decimal(16,0)") for c in (a, left, right)]
    square = (wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    product = (wide[1] * wide[2]).cast("decimal(38,0)")
    return F.call_function("div", square, product)


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages ``und``; repeated rows count again; an empty table gives no rows.  Other
    columns are not read.
    """
    texts = texts_of(docs, lang_column, text_column)
    words, seed = word_counts(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.groupBy("lang", "word").agg(F.sum("n").alias("a"), F.min("word_key").alias("word_key"))
    common = durable(_numbered(common.where(F.col("a") >= least), "word_key"))
    spellings = durable(words.select("lang", "word", "word_key").join(common.select("lang", "word", "id"), ["word", "lang"]))
    phrases = phrase_counts(texts, seed, spellings.select("word_key", "id"), least, longest)
    counts = _spelled(common, phrases)

    found = []
    for length in range(2, longest + 1):
        keys = _keys(length)
        phrase = counts[length - 1]
        cuts = []
        for k in range(1, length):
            # The frequencies of both sides of the cut: parts of a frequent phrase are frequent.
            left = counts[k - 1].select(*_keys(k), F.col("a").alias(f"l{k}"))
            right = counts[length - k - 1].select(
                *[F.col(f"w{i}").alias(f"w{i + k}") for i in range(1, length - k + 1)], F.col("a").alias(f"r{k}")
            )
            phrase = phrase.join(left, _keys(k)).join(right, keys[k:])
            l, r = F.col(f"l{k}"), F.col(f"r{k}")
            cuts.append(F.struct(_score(F.col("a"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        best = cuts[0] if len(cuts) == 1 else F.least(*cuts)
        phrase = phrase.select(*keys, "a", best.alias("cut"))
        if length < longest:
            longer = counts[length]
            parts = [
                longer.select(*[F.col(f"w{i + at}").alias(f"w{i}") for i in range(1, length + 1)], F.col("a").alias("outer"))
                for at in (0, 1)
            ]
            outer = reduce(DataFrame.unionByName, parts).groupBy(keys).agg(F.max("outer").alias("outer"))
            phrase = phrase.join(outer, keys, "left").where(
                F.col("outer").isNull() | (100 * F.col("outer") < INSIDE_PERCENT * F.col("a"))
            )
        named = phrase
        for i, key in enumerate(keys):
            spelled = common.select(
                F.col("id").alias(key), F.col("word").alias(f"word{i}"), *(["lang"] if not i else [])
            )
            named = named.join(spelled, key)
        found.append(
            named.select(
                "lang", F.concat_ws(" ", *[f"word{i}" for i in range(length)]).alias("phrase"), "a",
                F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
            )
        )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^ 	]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS part FROM texts)
), occurrences AS (
  SELECT lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM pieces WHERE len(words) > 0
), follow AS (
  SELECT lang, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third
  FROM occurrences WINDOW w AS (PARTITION BY piece ORDER BY pos)
), f1 AS (SELECT lang, word AS w1, count(*) AS a FROM follow GROUP BY ALL),
f2 AS (SELECT lang, word AS w1, second AS w2, count(*) AS a FROM follow WHERE second IS NOT NULL GROUP BY ALL),
f3 AS (
  SELECT lang, word AS w1, second AS w2, third AS w3, count(*) AS a FROM follow WHERE third IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.a, x.a AS l, y.a AS r, 1 AS k
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE p.a >= 10 AND NOT EXISTS (
    SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.a >= 50 * p.a
  ) AND NOT EXISTS (
    SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.a >= 50 * p.a
  )
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.a, x.a, y.a, 1
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.a, x.a, y.a, 2
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang) t ON t.lang = r.lang
WHERE r.rank <= 2000
"""
