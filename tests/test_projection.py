"""Bootstrap totals against the same draws made one by one."""

import hashlib
import random
from collections import defaultdict

import pytest

from lapwing.operators import projection as P

REPS = 40
#: Stratum, sample and its size: ties, a missing size, a missing stratum, a stratum without samples and one sample alone.
RNG = random.Random(5)
SAMPLES = [("big", i, RNG.randrange(40)) for i in range(25)] + [("small", i, RNG.randrange(900)) for i in range(4)]
SAMPLES += [("one", 1, 77), ("big", 99, None), (None, 5, 10), ("uncounted", 1, 3)]
COUNTS = [("big", 7), ("small", 3), ("one", 2), ("empty", 5)]


def _draw(*parts):
    return int(hashlib.sha256("|".join(str(p) for p in ("2216", *parts)).encode()).hexdigest()[:12], 16)


def _by_hand(block):
    held = defaultdict(list)
    for stratum, ident, size in SAMPLES:
        if stratum is not None and size is not None:
            held[stratum].append((size, ident))
    totals = dict.fromkeys(range(REPS), 0.0)
    for stratum, count in COUNTS:
        sizes = [size for size, _ in sorted(held.get(stratum, []))]
        n = len(sizes)
        for rep in totals if n else ():
            hits = defaultdict(int)
            for draw in range(n):
                hits[_draw(stratum, rep, draw) % n // block if n > block else 0] += 1
            drawn = 0
            for part, k in hits.items():
                mine = sizes[part * block : (part + 1) * block]
                drawn += sum(mine[_draw(stratum, rep, part, j) % len(mine)] for j in range(k))
            totals[rep] += count * drawn / n
    return totals


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(COUNTS, "stratum string, completed_count long"), spark.createDataFrame(
        SAMPLES, "stratum string, id long, bytes long"
    )


@pytest.mark.parametrize("block", [1, 4, 10_000])
@pytest.mark.parametrize("run", [3, 10_000])
def test_bootstrap_equals_single_draws(tables, monkeypatch, block, run):
    """Also when the draws of a repetition are spread over several tasks and runs."""
    monkeypatch.setattr(P, "_RUN", run)
    monkeypatch.setattr(P, "_RUNS", 2)
    got = {r["rep"]: r["total"] for r in P.bootstrap_totals(*tables, "id", REPS, block=block).collect()}
    assert got == pytest.approx(_by_hand(block))


def test_bootstrap_spreads_as_resampling_does(spark):
    """Mean and variance of a resampled mean: the mean of the samples and their variance over n."""
    sizes = [float(i * i % 101) for i in range(60)]
    counts = spark.createDataFrame([("s", 1)], "stratum string, completed_count long")
    samples = spark.createDataFrame([("s", i, int(b)) for i, b in enumerate(sizes)], "stratum string, id long, bytes long")
    got = [r["total"] for r in P.bootstrap_totals(counts, samples, "id", 1500, block=16).collect()]
    mean = sum(sizes) / 60
    variance = sum((b - mean) ** 2 for b in sizes) / 60 / 60
    middle = sum(got) / len(got)
    assert len(got) == 1500 and abs(middle - mean) < 4 * (variance / 1500) ** 0.5
    assert sum((g - middle) ** 2 for g in got) / 1500 == pytest.approx(variance, rel=0.2)


def test_bootstrap_of_nothing(spark, tables):
    empty = tables[1].limit(0)
    assert P.bootstrap_totals(tables[0], empty, "id", REPS).count() == 0
