"""Stratified size projection, bootstrap, envelopes and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapwing.operators.percentiles import grouped_percentiles
from lapwing.operators.scan import position, scan, series


def stratified_distribution(counts: DataFrame, samples: DataFrame, chunk_rows: int) -> DataFrame:
    """Size distribution per stratum joined to its completed count.

    ``counts``: stratum, completed_count.  ``samples``: stratum, bytes.  Both a
    full join: strata without samples stay visible.
    """
    quantiles = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    ranks = grouped_percentiles(samples, ["stratum"], "bytes", quantiles, chunk_rows)
    basics = samples.groupBy("stratum").agg(
        F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"), F.avg("bytes").alias("mean_bytes")
    )
    weak = F.col("samples") < 10
    return (
        counts.join(ranks.join(basics, "stratum"), "stratum", "left")
        .withColumn("samples", F.coalesce("samples", F.lit(0)))
        .withColumn("p95", F.when(F.col("samples") >= 20, F.col("p95")))
        .withColumn("upper_bytes", F.when(weak, F.col("max_bytes").cast("double")).otherwise(F.col("p90")))
        .withColumn("strength", F.when(F.col("samples") == 0, "missing").when(weak, "weak").otherwise("empirical"))
    )


def projection_totals(distribution: DataFrame, margin: float = 0.25) -> DataFrame:
    """Expected, conservative and stress totals over all strata."""
    n = F.col("completed_count")
    stress = F.sum(n * F.col("max_bytes"))
    return distribution.agg(
        F.sum("completed_count").alias("completed"),
        F.ceil(F.sum(n * F.col("mean_bytes"))).alias("expected_bytes"),
        F.ceil(F.sum(n * F.col("upper_bytes"))).alias("conservative_bytes"),
        stress.alias("stress_bytes"),
        F.ceil(stress * (1 + margin)).alias("stress_with_margin_bytes"),
        F.count(F.when(F.col("strength") == "missing", 1)).alias("missing_strata"),
        F.count(F.when(F.col("strength") != "empirical", 1)).alias("weak_strata"),
    )


#: Draws of one repetition that one task makes, as a number of runs of that many draws.
_RUN, _RUNS = 10_000, 10_000
#: Tasks that the draws are dealt to.
_TASKS = 192


def _stem(seed: int, *parts: Column | str) -> Column:
    """What the draws of one run have in common, put together once."""
    return F.concat_ws("|", F.lit(str(seed)), *parts, F.lit("")).alias("stem")


def _draw(stem: Column | str, number: Column | str) -> Column:
    digest = F.sha2(F.concat(stem, F.col(number).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _runs(start: Column, end: Column, step: int) -> Column:
    """Starts of the runs of ``step`` numbers in [start, end)."""
    return F.explode(F.sequence(start, end - 1, F.lit(step).cast("long")))


def _block_hits(sizes: DataFrame, reps: int, seed: int, block: int) -> DataFrame:
    """How many of a stratum's draws fall into each block, per repetition."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    one = sizes.where(F.col("n") <= block).select("stratum", rep, F.lit(0).cast("long").alias("block"), F.col("n").alias("k"))
    # A task draws for whole repetitions, so that its counts are few beside its draws.  What says whose draws they are
    # is few bytes for hours of drawing, so the tasks are a number of their own: by size they would become one.
    part = _RUN * _RUNS
    tasks = (
        sizes.where(F.col("n") > block)
        .select("stratum", "n", rep)
        .select("*", _runs(F.lit(0).cast("long"), F.col("n"), part).alias("part"))
        .repartition(_TASKS, "stratum", "rep", "part")
    )
    runs = tasks.select("*", _stem(seed, "stratum", "rep"), _runs(F.col("part"), F.least(F.col("part") + part, F.col("n")), _RUN).alias("run"))
    draws = runs.select("*", _runs(F.col("run"), F.least(F.col("run") + _RUN, F.col("n")), 1).alias("draw"))
    place = F.pmod(_draw("stem", "draw"), F.col("n"))
    many = draws.groupBy("stratum", "rep", F.floor(place / F.lit(block)).cast("long").alias("block")).agg(
        F.count(F.lit(1)).alias("k")
    )
    return one.unionByName(many)


def bootstrap_totals(
    counts: DataFrame, samples: DataFrame, ident: str, reps: int = 1000, seed: int = 2216,
    chunk_rows: int | None = None, block: int = 16_384,
) -> DataFrame:
    """Resampled stratified totals, one row per repetition.

    Each stratum of n samples draws n of them with replacement per repetition, in two steps: how many draws fall into
    each block of ``block`` samples, then which samples of the block they are.  The first needs no samples and is
    counted where it is drawn; the second happens beside the block's sizes.  So every sample is moved once, whatever
    the number of repetitions, and what else moves is counts of blocks and repetitions.  Draws are digests, so reruns
    agree.  Samples without a stratum or size are none; strata without samples or without a count add nothing.
    """
    known = samples.where(F.col("stratum").isNotNull() & F.col("bytes").isNotNull())
    numbered = scan(
        known.select("stratum", ident, F.col("bytes").cast("long").alias("bytes")),
        series(("stratum",), ("bytes", ident), chunk_rows),
        pos=position(),
    ).withColumn("block", F.floor((F.col("pos") - 1) / F.lit(block)).cast("long"))
    # At most ``block`` samples each.
    dealt = numbered.repartition(_TASKS, "stratum", "block")
    blocks = dealt.groupBy("stratum", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes")))["bytes"].alias("held"))
    sizes = known.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # Rows of an expression, not elements of a lambda: Spark compiles these, and sums them where they are drawn.
    picks = blocks.join(_block_hits(sizes, reps, seed, block), ["stratum", "block"]).select(
        "stratum", "rep", "held", _stem(seed, "stratum", "rep", "block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("draw")
    )
    pick = F.pmod(_draw("stem", "draw"), F.size("held"))
    totals = picks.groupBy("stratum", "rep").agg(F.sum(F.get("held", pick.cast("int"))).alias("bytes"))
    return (
        totals.join(sizes, "stratum").join(counts, "stratum")
        .groupBy("rep").agg(F.sum(F.col("completed_count") * (F.col("bytes") / F.col("n"))).alias("total"))
    )


def bootstrap_interval(totals: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the repetition totals (one row per repetition)."""
    return totals.agg(
        F.count(F.lit(1)).alias("repetitions"),
        F.percentile("total", F.lit(low)).alias("low_bytes"),
        F.percentile("total", F.lit(high)).alias("high_bytes"),
    )


def envelope_projection(samples: DataFrame, channels: DataFrame, candidates: int, margin: float = 0.25) -> DataFrame:
    """Upper envelope: largest sample times candidates plus margin.

    ``samples``: season, total_bytes.  ``channels``: channel, bytes.
    """
    per_channel = channels.groupBy("channel").agg(F.sum("bytes").alias("b"))
    stacked = samples.select(F.col("total_bytes").alias("t")).unionByName(
        per_channel, allowMissingColumns=True
    )
    return stacked.agg(
        F.ceil(F.max("t") * F.lit(candidates) * (1 + margin)).alias("projected_bytes"),
        F.count("t").alias("samples"),
        F.max_by("channel", F.when(F.col("b").isNotNull(), F.struct("b", "channel"))).alias("largest_channel"),
        F.max("b").alias("largest_channel_bytes"),
    )


def missing_years(samples: DataFrame, years: DataFrame) -> DataFrame:
    """Required years without a sample."""
    return years.join(samples.select("season").distinct(), "season", "left_anti")


def time_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest time over one or two time columns."""
    lows, highs = [F.min(c) for c in columns], [F.max(c) for c in columns]
    return df.agg(
        (F.least(*lows) if len(lows) > 1 else lows[0]).alias("min_time"),
        (F.greatest(*highs) if len(highs) > 1 else highs[0]).alias("max_time"),
    )


def stratified_sample(
    rows: DataFrame, stratum: Column, target: Column, pinned: Column, ident: str, seed: int = 2216
) -> DataFrame:
    """Deterministic sample: pinned members always, others up to the target.

    Members are ordered by pin and digest; a row's own target bounds its stratum.
    """
    keyed = rows.withColumn("stratum", stratum).withColumn("__target", target).withColumn(
        "__pin", F.coalesce(pinned, F.lit(False))
    ).withColumn("__draw", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256))
    kept = keyed.where("__pin").drop("__draw", "__pin", "__target").withColumn("pinned", F.lit(True))
    pins = keyed.where("__pin").groupBy("stratum").agg(F.count(F.lit(1)).alias("__pins"))
    # The first digits of the digest cut a stratum into 4096 even slices in order; only those that can still hold one
    # of the first ``target`` members are ranked, so no whole stratum meets in one place.
    pool = keyed.where(~F.col("__pin")).withColumn("__slice", F.substring("__draw", 1, 3))
    sizes = pool.groupBy("stratum", "__slice").agg(F.count(F.lit(1)).alias("__c"), F.max("__target").alias("__most"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy("stratum").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    most = F.max("__most").over(W.partitionBy("stratum"))
    near = sizes.withColumn("__before", before).withColumn("__most", most).where("__before < __most")
    w = W.partitionBy("stratum").orderBy("__draw", ident)
    ranked = pool.join(near.select("stratum", "__slice"), ["stratum", "__slice"]).withColumn(
        "__rank", F.row_number().over(w)
    )
    drawn = (
        ranked.join(pins, "stratum", "left")
        .where(F.col("__rank") <= F.col("__target") - F.coalesce("__pins", F.lit(0)))
        .drop("__draw", "__pin", "__target", "__rank", "__pins", "__slice")
        .withColumn("pinned", F.lit(False))
    )
    return kept.unionByName(drawn)

