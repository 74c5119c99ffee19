"""Joins, line dedup, quality rules, toxicity, leaks and the pipeline: against brute force on fixtures."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm import components, decontaminate, line_dedup, quality_rules, shingle_join, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def classes(texts, k, percent):
    sets = {key: shingles(text, k) for key, text in texts}
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {key: (len(sets[key]), root(key)) for key in keys}


def result(frame):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_similar_documents(docs, texts, k, percent):
    assert result(shingle_join.similar_documents(docs, k, percent)) == classes(texts, k, percent)


def test_families_of_near_copies_in_blocks(spark, monkeypatch):
    # Small limits send the same data through blocks instead of listed pairs.
    monkeypatch.setattr(shingle_join, "LISTED", 3)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for key in range(120):
        one = list(base)
        for _ in range(rng.randint(0, 5)):
            one[rng.randrange(90)] = f"e{rng.randint(0, 40)}"
        texts.append((key, " ".join(one)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert result(shingle_join.similar_documents(frame, 4, 85)) == classes(texts, 4, 85)


def test_links_between_blocks_of_classes():
    table = lambda rows: pa.table({
        "rep": [r[0] for r in rows], "root": [r[1] for r in rows], "n": pa.array([len(r[2]) for r in rows], pa.int32()),
        "tokens": [r[2] for r in rows]})
    left = table([(1, 1, list(range(20))), (2, 2, list(range(100, 120)))])
    right = table([(3, 3, list(range(19))), (4, 1, list(range(20))), (5, 5, list(range(101, 121)))])
    assert sorted(shingle_join._links_between(left, right, 85)) == [(1, 3), (2, 5)]


def test_similar_documents_of_odd_rows(spark, nothing):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (3, None), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in shingle_join.similar_documents(frame, 4, 85).collect())
    assert got == {(None, 3, None): 1, (4, 3, 2): 2, (2, 3, 2): 1, (3, 0, 3): 1, (9, 0, 9): 1}
    assert shingle_join.similar_documents(nothing).count() == 0
    assert shingle_join.drop_near_copies(frame, 4, 85).count() == 4


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    frame = spark.createDataFrame([*links, (None, 5), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert got == {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components.components(frame.limit(0)).count() == 0


def kept_lines(texts):
    split = {key: (text or "").split("\n") for key, text in texts}
    first = {}
    name = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    for key in sorted(split):
        for line in split[key]:
            first.setdefault(name(line), key)
    return {k: (len(v), [x for x in v if len(name(x)) < 10 or first[name(x)] == k]) for k, v in split.items()}


def test_line_dedup(docs, texts, nothing):
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.dedup_digest(docs).collect()}
    for key, (n, lines) in kept_lines(texts).items():
        assert got[key] == (n, n - len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {key: None if text is None else "\n".join(kept_lines(texts)[key][1]) for key, text in texts}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_digest(nothing).count() == 0


def test_line_dedup_across_slices(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_BITS", 2)
    rng = random.Random(6)
    texts = [(k * 3, "\n".join(f"line number {rng.randint(0, 30)}" for _ in range(rng.randint(1, 90)))) for k in range(60)]
    frame = spark.createDataFrame([*texts, (None, "line number 1")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_digest(frame).collect()}
    assert got == {None: 0, **{k: n - len(lines) for k, (n, lines) in kept_lines(texts).items()}}


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs, texts):
    rows = quality_rules.with_statistics(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r[0]: tuple(r)[1:] for r in rows.select("doc_id", *[quality_rules.count(n) for n in names]).collect()}
    assert got == {key: statistics(text) for key, text in texts}


def test_decision_list_is_learned_and_applied(spark, nothing):
    rng = random.Random(3)
    rows, labels = [], []
    for key in range(400):
        bad = key % 4 == 0
        words = [f"w{rng.randint(0, 500)}" + ("%%%" if bad and i % 2 else "") for i in range(80)]
        rows.append((key, " ".join(words)))
        labels.append((key, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (900, "few words"), (901, None)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.quality_digest(docs, marks).collect()}
    assert all(got[key]["kept"] == bool(label) for key, label in labels)
    assert got[900]["base_failed"] and not got[901]["kept"]
    kept = quality_rules.filter_quality(docs.withColumn("n_words", F.lit("other")), marks)
    assert kept.columns == ["doc_id", "text", "n_words"] and kept.count() == 300
    # Nothing to learn from: only the base rules hold.
    assert quality_rules.learn_rules(docs, marks.limit(0)) == []
    assert quality_rules.judge(docs, []).where("kept").count() == 400
    assert quality_rules.quality_digest(nothing.select("doc_id", "text"), marks).count() == 0


def test_rules_prune_to_what_holds():
    rng = np.random.default_rng(1)
    columns = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (columns["a"] > 0.7) & (rng.random(3000) > 0.02)
    rules = quality_rules.learn(columns, bad)
    assert rules[0].conditions[0][:2] == ("a", ">=") and abs(rules[0].conditions[0][2] - 0.7) < 0.02
    assert quality_rules.learn(columns, rng.random(3000) > 0.5) == []


def test_toxicity(spark, texts, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for key in range(600):
        words = [rng.choice("river stone glass cloud ocean paper light tree".split()) + str(rng.randint(0, 9)) for _ in range(60)]
        toxic = key % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["blockhead", "nitwit"]) + "."
        rows.append((key, " ".join(words)))
        labels.append((key, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(docs, marks).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[key]["predicted"] == label for key, label in labels if got[key]["held_out"]]
    assert 100 < len(right) < 300 and np.mean(right) > 0.98
    assert not got[900]["predicted"] and got[900]["score"] == got[901]["score"]
    one_class = toxicity.train(docs, marks.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs.limit(3), one_class).collect()} and toxicity.score(nothing, one_class).count() == 0


def test_toxicity_like_plain_counts_and_a_plain_fit(spark, monkeypatch):
    """Features in plain sets, ratios in plain counts, and the weights by Newton steps on the whole matrix."""
    rng = random.Random(3)
    rows = []
    for key in range(160):
        words = [rng.choice("river stone glass cloud ocean paper".split()) for _ in range(rng.randint(5, 30))]
        if key % 2:
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "nitwit"])
        rows.append((key, " ".join(words) * (1 + 40 * (key == 11)), key % 2))
    # Long texts are cut, an id that several documents share stays within the bound.
    monkeypatch.setattr(toxicity, "SLICE", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = toxicity.train(docs, docs.select("doc_id", F.col("label").alias("toxic")))
    sets = []
    for _, text, _ in rows:
        lowered = f" {text.lower()} "
        grams = {lowered[i : i + n] for n in toxicity.GRAMS for i in range(len(lowered) - n + 1)}
        sets.append({int(toxicity.hashed_grams([gram])[1][-1]) for gram in grams})
    monkeypatch.undo()
    for (_, text, _), want in zip(rows, sets, strict=True):
        assert set(toxicity.distinct_grams([text])[1].tolist()) == want
    label = np.array([r[2] for r in rows], float)
    counts = [Counter(f for one, r in zip(sets, rows, strict=True) if r[2] == kind for f in one) for kind in (0, 1)]
    size = [label.tolist().count(kind) for kind in (0.0, 1.0)]
    every = sorted(set().union(*sets))
    ratio = {f: np.log((counts[1][f] + 1) / (size[1] + 2) / ((counts[0][f] + 1) / (size[0] + 2))) for f in every}
    used = [f for f in every if model.weights[f] != 0]
    x = np.array([[ratio[f] if f in one else 0.0 for f in used] for one in sets])
    w, b = np.zeros(len(used)), 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        full = np.hstack([x, np.ones((len(x), 1))])
        slope = full.T @ (p - label) + np.append(toxicity.PENALTY * w, 0)
        curve = full.T @ (full * (p * (1 - p))[:, None]) + np.diag(np.append(np.full(len(used), toxicity.PENALTY), 1e-9))
        step = np.linalg.solve(curve, slope)
        w, b = w - step[:-1], b - step[-1]
    plain = 1 / (1 + np.exp(-(x @ w + b)))
    got = model.scores([r[1] for r in rows])
    assert np.abs(got - plain).max() < 0.05 and ((got >= 0.7) == (plain >= 0.7)).all()


def test_toxicity_bounds_its_sample_and_its_memory(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} {'bad' if i % 2 else 'good'} " * 5) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, sample_rows=50)
    assert model.scores(["bad " * 20])[0] > model.scores(["good " * 20])[0]
    tracemalloc.start()
    model.scores(["some words of a very long text " * 200_000])
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


ITEMS = [
    (1, "What color is the river stone near the old glass lamp by the ocean?\nIt is deep green, says the paper."),
    (2, "Quel est le nom du nuage que la pierre regarde? Le nom est lumière verte."),
    (3, ""), (None, "nothing"), (4, None), (5, "short one"),
]


def test_leaks(spark, docs, nothing):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    one, two = ITEMS[0][1], ITEMS[1][1]
    rows = [
        (1, f"{filler(200)} {one} {filler(300)}"), (2, one.upper().replace("\n", "  ")), (3, f"{filler(63)} {two}"),
        (4, filler(500)), (5, one.split("\n")[0]), (6, one.split("\n")[1]), (7, None), (8, ""), (9, f"{two} x {one}"),
        (9, two), (10, "the river is old and the stone near the lamp is green"), (None, two),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS[:5], "item_id long, text string")
    got = sorted((r["id"] or -1, r["item_id"]) for r in decontaminate.find_leaks(frame, items).collect())
    assert got == [(-1, 2), (1, 1), (2, 1), (3, 2), (9, 1), (9, 2), (9, 2)]
    assert decontaminate.drop_leaks(frame, items).count() == 7 and decontaminate.drop_leaks(frame, items).columns == frame.columns
    assert decontaminate.find_leaks(nothing, items).count() == 0 and decontaminate.find_leaks(frame, items.limit(0)).count() == 0


def test_shards_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 1)
    frame = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    got = sorted((r["id"], r["item_id"]) for r in decontaminate.find_leaks(frame, items).collect())
    assert got == [(1, 1), (2, 2)]


@pytest.mark.parametrize("shard", [20_000, 1])
def test_texts_of_one_item_and_items_of_one_word(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    one, two = ITEMS[0][1], ITEMS[1][1]
    schema = "item_id long, text string"
    items = spark.createDataFrame([(1, one), (1, two), (1, two), (5, "short one"), (6, "Zebra."), (7, one)], schema)
    rows = [(1, one), (2, two), (3, "a zebra there"), (4, "a short one there"), (5, "only a brief one"), (6, f"{one} x {two}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["item_id"]) for r in decontaminate.find_leaks(frame, items).collect())
    assert got == [(1, 1), (1, 7), (2, 1), (3, 6), (4, 5), (6, 1), (6, 1), (6, 7)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(frame, items).collect()) == [5]


def plain_scores(text, items):
    """BM25 of every window and piece by the formula, without bounds."""
    df, n = Counter(w for _, t in items for w in set(decontaminate.words_of(t))), len(items)
    words = decontaminate.words_of(text)
    windows = [set(words[i : i + 2 * decontaminate.STRIDE]) for i in range(0, max(1, len(words)), decontaminate.STRIDE)]
    lengths = [len(decontaminate.words_of(t)) for _, t in items]
    out = set()
    for (key, item), length in zip(items, lengths, strict=True):
        tf = Counter(decontaminate.words_of(item))
        rate = {
            w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / np.mean(lengths)))
            for w, c in tf.items()
        }
        if any(sum(v for w, v in rate.items() if w in window) >= 0.5 * sum(rate.values()) - 1e-9 for window in windows):
            out.add(key)
    return out


def test_bounds_lose_nothing(monkeypatch):
    # Without the overlap test every pair above the threshold comes out.
    monkeypatch.setattr(decontaminate, "QUESTION", 0.0)
    monkeypatch.setattr(decontaminate, "ANSWER", 0.0)
    rng = random.Random(7)
    word = lambda: f"w{int(rng.random() ** 3 * 300)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 40)))) for k in range(40)]
    index = decontaminate.build_index(items)
    texts = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += [" ".join(word() for _ in range(70)) + " " + items[k][1] for k in range(20)]
    for text, found in zip(texts, decontaminate.leaks_of(texts, index), strict=True):
        assert {key for key, *_ in found} == plain_scores(text, items)


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(rows)
        if number == 1:
            assert after == {k: "\n".join(lines) for k, (_, lines) in kept_lines(rows.items()).items()}
        if number == 2:
            assert set(after) == {k for k, (_, root) in classes(list(rows.items()), 5, 80).items() if k == root}
        rows = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["id"] for r in last.select("id").collect()} == set(rows)


def test_pipeline_decodes_what_it_encodes(spark, docs, texts):
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.columns == ["doc_id", "id", "ids", "n_tokens", "n_bytes", "decoded_sha256"]
    got = {r["doc_id"]: (r["n_bytes"], r["decoded_sha256"]) for r in last.collect()}
    assert got == {k: (len(data := (t or "").encode()), hashlib.sha256(data).hexdigest()) for k, t in texts}
    assert last.where("n_tokens != octet_length(ids) / 4 or id != doc_id").count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
