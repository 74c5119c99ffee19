"""Ordered scans over keyed series that do not depend on one task per key.

A plain window puts a whole key into a single task.  Here a series may name the
rows of a chunk: each key is cut along its order into as many equal spans as its
rows ask for, rows are windowed per (key, chunk), each chunk is reduced to one
summary row, the summaries are scanned per key, and the carry is joined back.
The large side is shuffled once on (key, chunk); what crosses chunks is one row
per chunk, so a key holding a third of the table still spreads over the cluster,
and ten times the rows give ten times the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "__chunk"
#: Key and chunk as one value: rows are dealt by it once, and NULL parts of it are equal in joins.
KEY = "__key"
_PAST = W.unboundedPreceding


@dataclass(frozen=True)
class Series:
    """Rows of one ordered sequence.

    ``keys`` and ``order`` are column names; NULL is a key like others and comes
    first in the order.  ``rows`` is how many rows a chunk has on average.  Without it the key is taken to be small (one
    driver in one race) and a plain window is used.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    rows: int | None = None

    def asc(self, extra: Sequence[str] = ()) -> W:
        return W.partitionBy(*self.keys, *extra).orderBy(*self.order)

    def desc(self, extra: Sequence[str] = ()) -> W:
        return W.partitionBy(*self.keys, *extra).orderBy(*[F.col(c).desc() for c in self.order])


def series(keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> Series:
    return Series(tuple(keys), tuple(order), rows)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def chunked(df: DataFrame, s: Series) -> DataFrame:
    """``df`` with each row's ``KEY``: spans of ``order[0]``, one for every ``rows`` rows of the key.

    Counts and ends are exact, so every reader of a plan cuts alike.
    """
    at = F.col(s.order[0]).cast("double")
    facts = F.struct(
        F.ceil(F.count(F.lit(1)) / F.lit(s.rows)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")
    ).alias("__facts")
    if s.keys:
        placed = join_same(df, df.groupBy(*s.keys).agg(facts), s.keys)
    else:
        placed = df.withColumn("__facts", df.agg(facts).scalar())
    f = F.col("__facts")
    place = F.floor((at - f["low"]) / (f["high"] - f["low"]) * f["n"])
    cut = (f["n"] > 1) & (f["high"] > f["low"]) & at.isNotNull()
    chunk = F.when(cut, F.least(place, f["n"] - 1)).otherwise(F.lit(0))
    return placed.withColumn(KEY, F.struct(*s.keys, chunk.cast("long").alias(CHUNK))).drop("__facts")


def _within(s: Series) -> Series:
    """The rows of one chunk."""
    return Series((KEY,), s.order)


def _unpacked(s: Series) -> list[Column]:
    return [KEY, *[F.col(KEY)[name].alias(name) for name in (*s.keys, CHUNK)]]


@dataclass(frozen=True)
class Step:
    """One scanned column: its window, its chunk summary and how both combine."""

    window: Callable[[Series, Sequence[str]], Column]
    summary: Callable[[Series], Column]
    carry: Callable[[Column, Series], Column]
    combine: Callable[[Column, Column], Column]


def _chunks_before(s: Series):
    return W.partitionBy(*s.keys).orderBy(CHUNK).rowsBetween(_PAST, -1)


def _chunks_after(s: Series):
    return W.partitionBy(*s.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(_PAST, -1)


def _ordered(s: Series, when: Column) -> Column:
    return F.when(when, F.struct(*s.order))


def latest(value: Column, inclusive: bool = True) -> Step:
    """Last non-NULL value at or before (or strictly before) the row."""
    end = 0 if inclusive else -1
    return Step(
        lambda s, x: F.last(value, ignorenulls=True).over(s.asc(x).rowsBetween(_PAST, end)),
        lambda s: F.max_by(value, _ordered(s, value.isNotNull())),
        lambda c, s: F.last(c, ignorenulls=True).over(_chunks_before(s)),
        lambda local, carry: F.coalesce(local, carry),
    )


def upcoming(value: Column, inclusive: bool = False) -> Step:
    """First non-NULL value after (or at or after) the row."""
    end = 0 if inclusive else -1
    return Step(
        lambda s, x: F.last(value, ignorenulls=True).over(s.desc(x).rowsBetween(_PAST, end)),
        lambda s: F.min_by(value, _ordered(s, value.isNotNull())),
        lambda c, s: F.last(c, ignorenulls=True).over(_chunks_after(s)),
        lambda local, carry: F.coalesce(local, carry),
    )


def _unwrap(step: Step) -> Step:
    return Step(
        step.window,
        step.summary,
        step.carry,
        lambda local, carry: F.coalesce(local, carry).getField("v"),
    )


def previous(value: Column) -> Step:
    """Value of the row before, NULLs included."""
    return _unwrap(latest(F.struct(value.alias("v")), inclusive=False))


def following(value: Column) -> Step:
    """Value of the row after, NULLs included."""
    return _unwrap(upcoming(F.struct(value.alias("v"))))


def _running(agg: Callable[[Column], Column], value: Column, merge, end: int = 0) -> Step:
    return Step(
        lambda s, x: agg(value).over(s.asc(x).rowsBetween(_PAST, end)),
        lambda s: agg(value),
        lambda c, s: agg(c).over(_chunks_before(s)),
        merge,
    )


def _add(local: Column, carry: Column) -> Column:
    return F.coalesce(local + carry, local, carry)


def running_sum(value: Column, inclusive: bool = True) -> Step:
    return _running(F.sum, value, _add, 0 if inclusive else -1)


def remaining_sum(value: Column) -> Step:
    """Sum over the rows after."""
    return Step(
        lambda s, x: F.sum(value).over(s.desc(x).rowsBetween(_PAST, -1)),
        lambda s: F.sum(value),
        lambda c, s: F.sum(c).over(_chunks_after(s)),
        _add,
    )


def remaining_min(value: Column) -> Step:
    """Smallest value of the rows after."""
    return Step(
        lambda s, x: F.min(value).over(s.desc(x).rowsBetween(_PAST, -1)),
        lambda s: F.min(value),
        lambda c, s: F.min(c).over(_chunks_after(s)),
        lambda local, carry: F.least(local, carry),
    )


def running_max(value: Column, inclusive: bool = True) -> Step:
    return _running(F.max, value, lambda a, b: F.greatest(a, b), 0 if inclusive else -1)


def running_min(value: Column, inclusive: bool = True) -> Step:
    return _running(F.min, value, lambda a, b: F.least(a, b), 0 if inclusive else -1)


def position() -> Step:
    """1-based row number in series order."""
    return running_sum(F.lit(1).cast("long"))


def scan(df: DataFrame, s: Series, /, **steps: Step) -> DataFrame:
    """Add one column per step."""
    if s.rows is None:
        none = F.lit(None)
        return df.select("*", *[st.combine(st.window(s, ()), none).alias(n) for n, st in steps.items()])
    base, names = chunked(df, s), list(steps)
    summary = base.groupBy(KEY).agg(*[steps[n].summary(s).alias(f"__s_{n}") for n in names])
    carried = summary.select(*_unpacked(s), *[f"__s_{n}" for n in names]).select(
        KEY, *[steps[n].carry(F.col(f"__s_{n}"), s).alias(f"__c_{n}") for n in names]
    )
    local = base.select("*", *[steps[n].window(_within(s), ()).alias(f"__l_{n}") for n in names])
    joined = local.join(carried, KEY, "left")
    return joined.select(
        *df.columns,
        *[steps[n].combine(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n in names],
    )


def trailing(df: DataFrame, s: Series, n: int, /, **values: Column) -> DataFrame:
    """Add, per value, the array of the last ``n`` rows up to the current one."""
    cols = F.struct(*[v.alias(k) for k, v in values.items()])
    frame = F.collect_list(cols)
    if s.rows is None:
        out = df.withColumn("__t", frame.over(s.asc().rowsBetween(-(n - 1), 0)))
    else:
        base = chunked(df, s)
        rank = F.row_number().over(_within(s).desc())
        tails = (
            base.select(KEY, *s.order, cols.alias("__v"), rank.alias("__rn"))
            .where(F.col("__rn") <= n)
            .groupBy(KEY)
            .agg(
                F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("o"), "__v"))).alias("__a")
            )
            .select(*_unpacked(s), F.transform("__a", lambda e: e["__v"]).alias("__a"))
        )
        before = W.partitionBy(*s.keys).orderBy(CHUNK).rowsBetween(-n, -1)
        carried = tails.select(
            KEY, F.flatten(F.collect_list("__a").over(before)).alias("__c")
        )
        local = base.withColumn("__l", frame.over(_within(s).asc().rowsBetween(-(n - 1), 0)))
        both = F.concat(F.coalesce("__c", F.array().cast("array<struct<" + ",".join(
            f"{k}:{t}" for k, t in _types(df, values)) + ">>")), F.col("__l"))
        out = (
            local.join(carried, KEY, "left")
            .withColumn("__b", both)
            .withColumn(
                "__t",
                F.when(F.size("__b") > n, F.slice("__b", -n, n)).otherwise(F.col("__b")),
            )
        )
    return out.select(*df.columns, *[F.transform("__t", _field(k)).alias(k) for k in values])


def _field(name: str) -> Callable[[Column], Column]:
    return lambda e: e[name]


def _types(df: DataFrame, values: dict[str, Column]):
    probe = df.select(*[v.alias(k) for k, v in values.items()]).schema
    return [(f.name, f.dataType.simpleString()) for f in probe.fields]


def islands(df: DataFrame, s: Series, state: Column, out: str = "island") -> DataFrame:
    """Number maximal runs of equal ``state`` (NULL is a state) in series order."""
    with_state = df.withColumn("__state", state)
    marked = scan(with_state, s, __prev=previous(F.struct(F.col("__state").alias("s"))))
    change = F.when(
        F.col("__prev").isNull() | ~F.col("__prev.s").eqNullSafe(F.col("__state")), 1
    ).otherwise(0)
    numbered = scan(marked.withColumn("__chg", change), s, **{out: running_sum(F.col("__chg"))})
    return numbered.drop("__state", "__prev", "__chg")
