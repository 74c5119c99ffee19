"""Learned decision lists over text statistics, with DataFrame functions only on the rows.

Statistics are columns of built-in functions.  Rules are learned on the driver from the statistics of a bounded sample
of labelled rows: sequential covering grows a conjunction of thresholds by information gain on one part of the sample,
prunes it from the end on the other, removes what it covers and goes on.  The list becomes one ordered conditional
expression, evaluated with the rest of the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the statistics: white space between words, symbols, and the two base rules.
SPACE = r"[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Statistics that rules may test, made from the counts.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "stops": "n_stops / n_words",
    "digits": "n_digits / n_words",
}
#: Labelled rows that a list is learned from, at most.
SAMPLE_ROWS = 20_000


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stops", "n_digits",
)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once however often it is named."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words in three-word windows that the text holds twice or more; windows are compared by a 64-bit hash.  Only texts
# with a repeated window pay for sorting them.
_WINDOWS = (
    "CASE WHEN size(x.w) > 2"
    " THEN slice(transform(x.w, (v, i) -> xxhash64(v, get(x.w, i + 1), get(x.w, i + 2))), 1, size(x.w) - 2)"
    " ELSE cast(array() AS array<bigint>) END"
)
_COVERED = (
    "size(array_distinct(flatten(transform("
    "filter(s, (p, j) -> p.h = get(s, j - 1).h OR p.h = get(s, j + 1).h), p -> array(p.i, p.i + 1, p.i + 2)))))"
)
_PLACES = "sort_array(transform(h, (v, i) -> named_struct('h', v, 'i', i)))"
_REPEATS = _let(
    _WINDOWS, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {_let(_PLACES, 's', _COVERED)} END"
)


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``__counts``, a struct of the count columns of its whole texts.

    Null and empty texts have no words and counts of 0.  The struct comes from an explode of one element, which the
    optimizer does not copy into the filters above it.
    """
    text = f"coalesce(`{text_column}`, '')"
    kept = lambda chars: f"bigint(char_length(regexp_replace({text}, '[^{chars}]+', '')))"
    parts = (
        f"named_struct('w', array_remove(split({text}, '{SPACE}', -1), ''),"
        f" 'l', filter(split({text}, '\n', -1), v -> v RLIKE '[^ \\t-\\r]'))"
    )
    counts = _let(
        parts, "x",
        "named_struct('n_words', bigint(size(x.w)), 'word_chars', bigint(char_length(array_join(x.w, ''))),"
        f" 'n_symbols', {kept(SYMBOLS)}, 'n_lines', bigint(size(x.l)),"
        " 'n_dup_lines', bigint(size(x.l) - size(array_distinct(x.l))),"
        f" 'n_repeat_words', bigint({_REPEATS}), 'n_stops', {kept('.!?')}, 'n_digits', {kept('0-9')})",
    )
    return docs.select("*", F.explode(F.array(F.expr(counts))).alias("__counts"))


def count(name: str) -> Column:
    return F.col(f"__counts.{name}")


def base_failed() -> Column:
    """The two fixed rules."""
    return (count("n_words") < LEAST_WORDS) | (100 * count("n_repeat_words") > MOST_REPEATED * count("n_words"))


def feature(name: str) -> Column:
    """A statistic as a number; shares of nothing are shares of one."""
    over, _, under = FEATURES[name].partition(" / ")
    return count(over) / F.greatest(count(under), F.lit(1)) if under else count(over).cast("double")


# -- learning -------------------------------------------------------------------------------------


@dataclass
class Rule:
    """Rows that meet every condition (feature, sign, threshold) are rejected."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), bool)
        for name, sign, cut in self.conditions:
            out &= columns[name] >= cut if sign == ">=" else columns[name] <= cut
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gained for each covered example of the class, times those covered."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule, inside = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < most:
        p0, n0 = float((bad & inside).sum()), float((~bad & inside).sum())
        if not n0 or not p0:
            break
        best, chosen = 1e-9, None
        for name, values in columns.items():
            order = np.argsort(values[inside], kind="stable")
            v, b = values[inside][order], bad[inside][order]
            up, total = np.cumsum(b), b.sum()
            ends = np.flatnonzero(np.r_[v[1:] != v[:-1], True])[:-1]
            if not len(ends):
                continue
            low = _gain(up[ends].astype(float), (ends + 1 - up[ends]).astype(float), p0, n0)
            rest = total - up[ends]
            high = _gain(rest.astype(float), (len(b) - ends - 1 - rest).astype(float), p0, n0)
            for gains, sign in ((low, "<="), (high, ">=")):
                i = int(np.argmax(gains))
                if gains[i] > best:
                    # Halfway to the next value, so that unseen rows near the border fall on the nearer side.
                    best, chosen = gains[i], (name, sign, float((v[ends[i]] + v[ends[i] + 1]) / 2))
        if chosen is None:
            break
        rule.conditions.append(chosen)
        inside = rule.covers(columns)
    return rule


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The first conditions that do best on rows the rule has not seen."""
    best, kept = -np.inf, rule
    for size in range(len(rule.conditions), 0, -1):
        part = Rule(rule.conditions[:size])
        hit = part.covers(columns)
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, part
    return kept


def learn(
    columns: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 20, most_tests: int = 4
) -> list[Rule]:
    """The decision list; a rule that is right on less than ``precision`` of unseen rows ends it."""
    part = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (bad & left & ~part).any():
        cut = lambda where: {k: v[where] for k, v in columns.items()}
        grow, prune = left & ~part, left & part
        rule = _prune(_grow(cut(grow), bad[grow], most_tests), cut(prune), bad[prune])
        hit = rule.covers(columns) & left
        unseen = hit & part
        if not rule.conditions or not unseen.any() or (bad & unseen).sum() < precision * unseen.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn_rules(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id",
    text_column: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """Rules that reject rows labelled 0, from at most ``sample_rows`` labelled rows with an id and a label.

    Rows are chosen by a hash of their id, so the sample is the same for the same rows.  Without labelled rows of both
    kinds the list is empty.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("__id")).agg(F.min(label_column).alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    text = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    # The sample's size is the parameter, whatever the tables hold.
    rows = with_statistics(text.join(F.broadcast(known), "__id"), "__text").where(~base_failed())
    names = list(FEATURES)
    found = rows.select("__id", "__label", *[feature(n).cast("double").alias(f"__{n}") for n in names])
    values = sorted(tuple(row) for row in found.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).collect())
    if not values:
        return []
    table = np.array([row[1:] for row in values], float)
    order = np.random.default_rng(7).permutation(len(table))
    table = table[order]
    return learn({n: table[:, i + 1] for i, n in enumerate(names)}, table[:, 0] == 0)


def rejected(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, as an ordered conditional expression; null if none."""
    out = None
    for number, rule in enumerate(rules):
        test = F.lit(True)
        for name, sign, cut in rule.conditions:
            test = test & (feature(name) >= cut if sign == ">=" else feature(name) <= cut)
        out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """``docs`` with ``__counts``, ``base_failed``, ``rule`` (of the list, null if none) and ``kept``."""
    rows = with_statistics(docs, text_column).withColumns({"base_failed": base_failed(), "rule": rejected(rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query."""
    rows = judge(docs.select("doc_id", "text"), learn_rules(docs, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[count(name).alias(name) for name in names], "base_failed", "kept", "rule")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the base rules or the list reject."""
    judged = judge(docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text")),
                   learn_rules(docs, labels), "__text")
    return judged.where("kept").select("__row.*")
