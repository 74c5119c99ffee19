"""Spelling variants, packing and collocations: against plain counts, odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lapwing.llm import collocations, packing, spelling

JSON = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- spelling -------------------------------------------------------------------------------------


def near(a, b):
    """By trying every edit of the shorter word."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_forms(counts):
    words = sorted(counts)
    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(around[w]), counts[form[w]] if form[w] else None))
    return out


def forms(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def variants(rng, n):
    """Words of few letters with long common ends, so that edits meet, overlap and repeat letters."""
    out = Counter()
    for _ in range(n):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(3, 4))) + rng.choice(["aaaa", "abab", "ing"])
        out[word] += rng.choice([1, 3, 40, 900])
    return out


@pytest.mark.parametrize("tile_words", [2, 5, 96])
def test_forms_match_all_pairs(spark, tile_words):
    counts = variants(random.Random(tile_words), 260)
    counts |= {"z" * 3000: 5, "z" * 3001: 60, "z" * 2999 + "é": 700, "漢字かな交じり文": 4, "漢字かな交じり": 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert forms(spelling.variant_forms(words, tile_words=tile_words)) == plain_forms(counts)


def test_chains_end_at_the_last_form(spark):
    counts = {"aaaaaaa" + "b" * i: 10**i for i in range(1, 12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r["word"]: r["root"] for r in spelling.variant_forms(words).collect()}
    assert set(found.values()) == {"aaaaaaa" + "b" * 11}


def test_words_of_texts_match_plain_counts(spark):
    rng = random.Random(2)
    base = ["différence", "language", "Lantern", "STATION", "Übermorgen", "measure", "tiny"]
    texts = [" ".join(rng.choices(base, k=40)) + "x" * (i % 9) for i in range(300)]
    texts += [None, "", "   ", "Language_language-language", "a" * 50_000, texts[0], texts[0]]
    counts = Counter()
    rows = list(enumerate(texts)) + [(7, texts[3]), (7, texts[3]), (None, texts[4])]
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    schema = "doc_id long, text string, word string, n long, near string, h long, run string"
    docs = spark.createDataFrame([(k, t, "w", 1, "x", 5, "r") for k, t in rows], schema).repartition(4)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == want
    assert forms(spelling.spelling_variants(docs)) == plain_forms(want)


def test_no_words(docs, nothing):
    assert spelling.spelling_variants(nothing).count() == 0


# -- packing --------------------------------------------------------------------------------------


def placed(plan, counts):
    """Ranges of ids of every rest, and what every sequence holds, written out."""
    rests = defaultdict(list)
    sequences = defaultdict(list)
    for length, lo, hi, begin, size, sequence, offset in plan.tolist():
        for rank in range(lo, hi):
            rests[length, rank].append((begin, begin + size))
            sequences[sequence + rank - lo].append((offset, size))
    assert set(rests) == {(length, rank) for length, n in counts.items() for rank in range(n)}
    for (length, _), parts in rests.items():
        assert [0, *(end for _, end in sorted(parts))] == [*(begin for begin, _ in sorted(parts)), length]
    totals = {}
    for sequence, parts in sequences.items():
        parts.sort()
        assert [offset for offset, _ in parts] == np.cumsum([0, *(size for _, size in parts)])[:-1].tolist()
        totals[sequence] = sum(size for _, size in parts)
    return totals


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_id_without_padding(seed):
    rng = random.Random(seed)
    kinds = [range(1, 64), [63], [1], [40, 41], [3, 62], [7, 20, 21, 33]]
    counts = dict(Counter(rng.choice(list(kinds[seed])) for _ in range(rng.choice([1, 5, 900]))))
    plan, n, _ = packing.plan_rests(counts, window=64)
    totals = placed(plan, counts)
    assert sorted(totals) == list(range(n))
    assert all(total == 64 or total & (total - 1) == 0 for total in totals.values())
    assert sum(total < 64 for total in totals.values()) <= 6


def test_least_squares_solve_what_combinations_can_fill():
    # 30 of 10+54, 20 of 20+20+24 and 10 of 4 * 15 + 4 explain the counts.
    counts = np.zeros(65)
    counts[[10, 54, 20, 24, 15, 4]] = [30, 30, 40, 20, 40, 10]
    used, times = packing.combinations(64, np.flatnonzero(counts))
    assert ((used * times).sum(axis=1) == 64).all()
    x = packing.repeat_counts(used, times, counts, steps=2000)
    assert (x >= 0).all()
    got = np.bincount(used.reshape(-1), (times * x[:, None]).reshape(-1), 65)
    assert np.abs(got - counts)[1:].max() < 0.5
    # Uniform lengths: nearly all sequences come from the solved counts, and few rests are cut.
    many = {length: 1000 for length in range(1, 64)}
    plan, n, solved = packing.plan_rests(many, window=64)
    assert solved > 0.9 * n and (plan["hi"] - plan["lo"]).sum() < 1.1 * 63_000


def test_pieces_hold_every_document_once(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.pack_documents(docs, JSON, end_id=0, window=256, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        assert row["ids_crc32"] == zlib.crc32(row["ids"]) and len(row["ids"]) == 4 * row["length"]
        pieces[row["id"]].append(row)
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    assert set(pieces) == {key for key, _ in texts}
    for key, text in texts:
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(pieces[key], key=lambda row: row["start"])
        assert b"".join(row["ids"] for row in parts) == want
        assert {row["doc_tokens"] for row in parts} == {len(want) // 4}
        assert [row["start"] for row in parts] == np.cumsum([0, *(row["length"] for row in parts)])[:-1].tolist()
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        assert [offset for offset, _ in parts] == np.cumsum([0, *(size for _, size in parts)])[:-1].tolist()
        total = sum(size for _, size in parts)
        assert total == 256 or total & (total - 1) == 0


def test_packing_of_repeated_null_and_no_rows(spark, nothing):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None), (None, "x"), (2, "")], "doc_id long, text string")
    rows = packing.pack_documents(docs, JSON, end_id=0).collect()
    assert Counter(row["id"] for row in rows if row["start"] == 0) == {1: 2, None: 2, 2: 1}
    # 3 + 3 + 1 + 2 + 1 ids: a sequence of eight and one of two.
    assert Counter(row["sequence_id"] for row in rows).keys() == {0, 1}
    assert sum(row["length"] for row in rows) == 10
    assert packing.pack_documents(nothing, JSON, end_id=0).count() == 0


# -- collocations ---------------------------------------------------------------------------------


def plain_collocations(rows, least, longest, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for phrase, c in f.items() if len(phrase) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in candidates.items()
            )
            if not inside:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, l, r = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "top", "broadcast"), [(3, 2000, 500_000), (4, 15, 0), (2, 3, 500_000)])
def test_collocations_match_plain_counts(spark, monkeypatch, longest, top, broadcast):
    rng = random.Random(longest)
    words = ["New", "York", "city", "of", "the", "été", "😀", " x", "Ünder", "a-b"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "fr", None]), text + " new York City" * (i % 3)))
    rows += [("en", None), ("de", ""), ("de", " \t."), ("en", "the the the " * 3000), ("und", "a b"), rows[0], rows[0]]
    schema = "lang string, text string, piece long, word string, n long, place int, w1 long, a long"
    docs = spark.createDataFrame([(*row, 1, "x", 2, 3, 4, 5) for row in rows], schema).repartition(5)
    monkeypatch.setattr(collocations, "BROADCAST_GROUPS", broadcast)
    got = collocations.collocations(docs, least=10, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 10, longest, top)


def test_spellings_count_as_one_word_and_pieces_part_words(spark):
    texts = [("en", "New York")] * 4 + [("en", "new\tYORK.")] * 4 + [("en", ".nEw york")] * 4
    texts += [("en", "big,apple"), ("en", "big ; apple"), ("en", "big\x0bapple"), ("en", "big "), ("en", "apple"), ("fr", "É é")] * 10
    got = collocations.collocations(spark.createDataFrame(texts, "lang string, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == plain_collocations(texts, 10, 3, 2000)
    assert {row["phrase"]: row["a"] for row in got.collect()} == {"new york": 12, "É é": 10}


def test_stored_occurrences_join_without_moving_or_sorting(spark):
    before = {name: spark.conf.get(name, None) for name in collocations.SETTINGS}
    rows = [(doc, place, doc * place % 7) for doc in range(40) for place in range(30)]
    relation = spark.createDataFrame(rows, "doc long, place int, id long")
    tables = collocations._Occurrences(relation)
    try:
        for name, value in collocations.SETTINGS.items():
            spark.conf.set(name, value)
        ends, starts = tables.store(tables.deal(relation))
        starts = starts.select("doc", F.col("after").alias("place"), "id").hint("merge")
        joined = starts.join(ends.withColumnRenamed("id", "last"), ["doc", "place"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        want = sorted((doc, place + 1, n, doc * (place + 1) % 7) for doc, place, n in rows if place < 29)
        assert sorted(map(tuple, joined.collect())) == want
    finally:
        tables.forget()
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_scores_past_64_bits_are_exact(spark):
    a, l, r = 3_000_000_000_001, 3_000_000_000_007, 3_000_000_000_019
    row = spark.range(1).select(collocations._score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_no_collocations(nothing):
    assert collocations.collocations(nothing).count() == 0
