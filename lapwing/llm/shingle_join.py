"""Similarity join of documents by word shingles, with adaptive multi-match prefixes.

Two documents whose shingle sets are similar enough must share some of the first shingles of each in any order that is
the same for both; with a prefix longer by l - 1 they must share l of them.  That is used twice.

1. In order of hash, every document posts a prefix.  Those that share too few of its shingles with anyone have no
   partner, and most documents end here.  Documents with the same set are one from the start.
2. The rest are ordered by frequency, rare shingles first.  Each document picks its prefix length: for every l, the
   postings to scan and the candidates to verify are estimated from the frequencies, and the cheapest l is used.

Candidates are verified on the whole sets.  Large groups are not paired out: every document is first compared with the
smallest and largest document that its prefix shingles name, which joins most copies to one class.  Then only pairs
of different classes matter.  Those that meet at a seldom shingle are listed; those that meet at a frequent one belong
to one family and are compared block by block inside a task, which returns the few links that join classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.components import components, stored
from lapwing.session import durable

#: Longest surplus l of a frequency-ordered prefix.
MOST_MATCHES = 4
#: What verifying a candidate costs, in postings scanned, for each shingle of a document.
VERIFY_COST = 1 / 16
#: Postings of a shingle up to which its pairs are listed; beyond, they are compared in blocks.
LISTED = 100
#: Documents in a block of a family.
BLOCK = 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased; words are what white space (space, tab to carriage return) leaves; a shorter text is one
    shingle; a null text or one without words has none.
    """
    from xxhash import xxh3_64_intdigest

    lists = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    flat = np.array([xxh3_64_intdigest(word) for one in lists for word in one], dtype=np.uint64)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for i in range(words):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - words + 1 + i]) if len(rolled) else rolled
    out, at = [], 0
    for one in lists:
        if len(one) >= words:
            out.append(np.unique(rolled[at : at + len(one) - words + 1]))
        elif one:
            # Fewer words than a shingle has: the whole sequence, with its length, is the one shingle.
            h = np.array([len(one)], np.uint64)
            for i in range(len(one)):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[at + i : at + i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(one)
    return out


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _surplus(n: int, percent: int) -> int:
    """l of the hash-ordered prefix of a set of n; it does not fall as n grows."""
    return min(_least_overlap(n, percent), n // 20 + 5)


def sketches(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """id, n, sig (128 bits of the set), need, tokens (its prefix in order of hash)."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            sizes = [len(s) for s in sets]
            prefix = [s[: n - _least_overlap(n, percent) + _surplus(n, percent)] for s, n in zip(sets, sizes, strict=True)]
            # A partner has at least this part of the size, and no smaller surplus than such a set.
            need = [_surplus(_least_overlap(n, percent), percent) for n in sizes]
            ends = np.cumsum([0, *[len(p) for p in prefix]]).astype(np.int32)
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int32()),
                    pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(need, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["id", "n", "sig", "need", "tokens"],
            )

    return rows.mapInArrow(work, "id long, n int, sig binary, need int, tokens array<long>")


def _full_sets(rows: DataFrame, words: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["rep", "n", "tokens"],
            )

    return rows.mapInArrow(work, "rep long, n int, tokens array<long>")


def _similar(both: Column, left: Column, right: Column, percent: int) -> Column:
    return 100 * both >= percent * (left + right - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("__n"), F.col("tokens").alias("__t"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("__m"), F.col("tokens").alias("__u"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("__t", "__u"))
    return joined.where(_similar(both, F.col("__n"), F.col("__m"), percent)).select("a", "b")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, alone (shingles nobody else has), l, token: the frequency-ordered prefixes of documents with partners."""
    posts = sets.select("rep", "n", F.explode("tokens").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = posts.join(common, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # Shingles of its own come first in a document's order; the prefix for l = 1 has n - least + 1 shingles.
    sized = lists.withColumn("alone", F.col("n") - F.size("shared")).withColumn(
        "first", F.expr(f"n - cast(ceil({percent} * n / 100.0D - 1e-9) AS int) + 1 - alone")
    )
    able = sized.where("first > 0")
    costs = []
    for surplus in range(1, MOST_MATCHES + 1):
        scan = f"aggregate(slice(shared, 1, first + {surplus - 1}), 0L, (s, x) -> s + x.df - 1)"
        cost = f"{scan} * (1 + n * {VERIFY_COST}D / {surplus})"
        costs.append(f"CASE WHEN first + {surplus - 1} <= size(shared) THEN struct({cost} AS cost, {surplus} AS l) END")
    chosen = able.withColumn("l", F.expr(f"array_min(array({', '.join(costs)})).l"))
    prefix = F.expr("slice(shared, 1, first + l - 1)")
    return chosen.select("rep", "n", "alone", "l", F.explode(prefix).alias("p")).select(
        "rep", "n", "alone", "l", F.col("p.token").alias("token")
    )


def _leader_pairs(posts: DataFrame) -> DataFrame:
    """Each document with the two it meets most often among the smallest and among the largest of its shingles."""
    ends = posts.groupBy("token").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    near = posts.select("rep", "token").join(ends, "token")
    each = near.select("rep", F.explode(F.array("low", "high")).alias("lead")).where("rep <> lead")
    counted = each.groupBy("rep", "lead").agg(F.count("*").alias("c"))
    order = Window.partitionBy("rep").orderBy(F.desc("c"), "lead")
    best = counted.withColumn("turn", F.row_number().over(order)).where("turn <= 3")
    return best.select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b")).distinct()


def _possible(percent: int) -> str:
    """Sizes and shingles of their own leave room for the overlap that sets of x and y need."""
    room = f"{100 + percent} * least(x.n - x.alone, y.n - y.alone) >= {percent} * (x.n + y.n)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {room}"


def _listed_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different classes that share enough shingles of few postings."""
    x, y = posts.alias("x"), posts.alias("y")
    met = x.join(y, F.expr(f"x.token = y.token AND x.rep < y.rep AND x.root <> y.root AND {_possible(percent)}"))
    counted = met.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(
        F.count("*").alias("c"), F.min(F.least("x.l", "y.l")).alias("l")
    )
    return counted.where("c >= l").select("a", "b")


def _block_links(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes among documents that meet at shingles of many postings."""
    lead = posts.groupBy("token").agg(F.min("rep").alias("b"))
    tied = posts.select("token", F.col("rep").alias("a")).join(lead, "token").select("a", "b")
    family = components(tied).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    members = posts.select("rep", "root").distinct().join(family, "rep")
    sizes = members.groupBy("family", "root").agg(F.count("*").alias("c"))
    sized = members.join(sizes, ["family", "root"])
    # Large classes fill blocks of their own, the small classes of a family share some.
    own = F.col("c") > BLOCK // 2
    few = sizes.where(f"c <= {BLOCK // 2}").groupBy("family").agg(F.sum("c").alias("few"))
    placed = sized.join(few, "family", "left").select(
        "family", "rep", "root", F.when(own, F.col("root")).alias("pure"),
        F.when(own, F.expr(f"pmod(xxhash64(rep), ceil(c / {BLOCK}))"))
        .otherwise(F.expr(f"pmod(xxhash64(root), ceil(few / {BLOCK}))"))
        .alias("slot"),
    )
    block = F.xxhash64("family", F.coalesce("pure", F.lit(-1)), F.col("pure").isNull(), "slot")
    placed = stored(placed.withColumn("block", block))
    blocks = placed.select("family", "pure", "block").distinct()
    mixed = blocks.alias("x").join(
        blocks.alias("y"), F.expr("x.family = y.family AND (x.block < y.block OR x.block = y.block AND x.pure IS NULL)"
                                  " AND NOT (x.pure <=> y.pure AND x.pure IS NOT NULL)")
    )
    pairs = mixed.select(F.col("x.block").alias("left"), F.col("y.block").alias("right"))
    whole = stored(placed.select("block", "rep", "root").join(sets, "rep"))
    task = F.xxhash64("left", "right").alias("task")
    one = pairs.select(task, F.col("left").alias("block"), F.lit(0).alias("side"))
    two = pairs.select(task, F.col("right").alias("block"), F.lit(1).alias("side"))
    dealt = one.unionByName(two).join(whole, "block").select("task", "side", "rep", "root", "n", "tokens")

    def work(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        found = _links_between(rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1)), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("task").applyInArrow(work, "a long, b long")


def _links_between(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join classes, at most one fewer than there are classes."""
    reps, roots, sizes = (left[c].to_numpy() for c in ("rep", "root", "n"))
    flat = left["tokens"].combine_chunks()
    flat = flat.flatten().to_numpy()
    owner = np.repeat(np.arange(len(reps)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent: dict[int, int] = {}

    def root_of(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for rep, root, n, tokens in zip(*(right[c].to_pylist() for c in ("rep", "root", "n", "tokens")), strict=True):
        begin, end = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        counts = end - begin
        at = np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], minlength=len(reps))
        for i in np.flatnonzero((100 * both >= percent * (sizes + n - both)) & (roots != root)):
            a, b = root_of(int(roots[i])), root_of(root)
            if a != b:
                parent[a] = b
                found.append((int(reps[i]), rep))
    return found


def similar_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their sets of distinct ``words``-word shingles; the
    component is the smallest id reachable.  Texts without words link with nothing.  Rows with the same id are one
    document, linked through any of its texts; rows without an id are their own, with a null component.  Ids are
    integers; other columns are not read.  An empty table gives an empty result.
    """
    sketch = durable(sketches(docs, words, percent, id_column, text_column))
    real = sketch.where("n > 0 AND id IS NOT NULL")
    same = real.groupBy("n", "sig").agg(F.min(F.struct("id", "need", "tokens")).alias("first"))
    reps = same.select(F.col("first.id").alias("rep"), F.col("first.need").alias("need"), F.col("first.tokens").alias("tokens"))
    posts = reps.select("rep", "need", F.explode("tokens").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    met = posts.join(common, "token").groupBy("rep").agg(F.count("*").alias("c"), F.min("need").alias("need"))
    able = stored(met.where("c >= need").select("rep"))
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text_column).alias("text"))
    sets = durable(_full_sets(texts.join(able, "rep", "left_semi"), words))

    prefixes = stored(_prefixes(sets, percent))
    links = stored(verify(_leader_pairs(prefixes), sets, percent))
    roots = components(links)
    rooted = prefixes.join(roots, prefixes["rep"] == roots["node"], "left")
    rooted = stored(rooted.select("rep", "n", "alone", "l", "token", F.coalesce("root", "rep").alias("root")))
    # Shingles whose documents are all of one class have nothing left to join.
    usage = rooted.groupBy("token").agg(F.count("*").alias("g"), F.min("root").alias("r"), F.max("root").alias("s"))
    usage = usage.where("r < s").select("token", (F.col("g") > LISTED).alias("frequent"))
    open_posts = stored(rooted.join(usage, "token"))
    listed = verify(_listed_pairs(open_posts.where("NOT frequent"), percent), sets, percent)
    blocks = _block_links(open_posts.where("frequent"), sets, percent)

    # Documents with one set are tied to the first of them.
    first = same.select("n", "sig", F.col("first.id").alias("rep"))
    copies = real.join(first, ["n", "sig"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = links.unionByName(listed).unionByName(blocks).unionByName(copies)
    classes = components(found)
    joined = sketch.join(classes, sketch["id"] == classes["node"], "left")
    return joined.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows without an id stay."""
    classes = similar_documents(docs, words, percent, id_column).where("id <> component_id").select("id").distinct()
    return docs.join(classes, docs[id_column].cast("long") == classes["id"], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
      CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id
), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 85 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM t
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = t.doc_id
"""
