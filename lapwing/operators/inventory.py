"""Session inventory: completion, provider matching, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.operators.asof import unique_within
from lapwing.operators.scan import previous, scan, series

# Statuses a session status feed may carry.
KNOWN_STATUSES = ("Inactive", "Started", "Aborted", "Finished", "Finalised", "Ends")


def completion_state(
    scheduled: Column, last_status: Column, started: Column, cancelled: Column,
    archive_complete: Column, supported: Column,
) -> Column:
    """Completion from the schedule and the final status; first rule wins."""
    closed = last_status.isin("Finalised", "Ends")
    return (
        F.when(scheduled == "future", "future")
        .when(cancelled | (scheduled == "cancelled"), "cancelled")
        .when(closed & started, "completed")
        .when(closed, "abandoned-no-data")
        .when(last_status == "Aborted", "abandoned-no-data")
        .when(archive_complete & started, "completed")
        .when(supported.eqNullSafe(F.lit(False)), "unsupported")
        .otherwise("unverified")
    )


def classify_completion(sessions: DataFrame, status_log: DataFrame) -> DataFrame:
    """State per session, including the evidence overrides.

    ``sessions``: session_id, scheduled_state, cancelled, archive_complete,
    supported, source_missing, integrity.  ``status_log``: session_id, seq, status.
    """
    log = status_log.groupBy("session_id").agg(
        F.max_by("status", F.struct("seq", "status")).alias("last_status"),
        F.bool_or(F.col("status") == "Started").alias("started"),
    )
    no = F.lit(False)
    base = sessions.join(log, "session_id", "left").withColumn(
        "state",
        completion_state(
            F.col("scheduled_state"), F.coalesce("last_status", F.lit("")),
            F.coalesce("started", no), F.coalesce("cancelled", no),
            F.coalesce("archive_complete", no), F.col("supported"),
        ),
    )
    state = F.when(
        F.coalesce("source_missing", no) & (F.col("state") != "future"), "abandoned-no-data"
    ).otherwise(F.col("state"))
    base = base.withColumn("state", state)
    return base.withColumn(
        "state",
        F.when(
            F.coalesce(F.col("integrity").isin("invalid", "ambiguous"), no)
            & ~F.col("state").isin("future", "cancelled"),
            "unverified",
        ).otherwise(F.col("state")),
    )


def status_chronology(log: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Issue code per status row; NULL for rows in order.

    Feed order is ``seq``; times are nanoseconds.
    """
    s = series(("session_id",), ("seq",), chunk_rows)
    rows = scan(log, s, __p=previous(F.struct("time_ns", "status")))
    before, now = F.col("__p.time_ns"), F.col("time_ns")
    tie_ok = (F.col("__p.status") == "Finalised") & (F.col("status") == "Ends")
    issue = (
        F.when(F.col("status").isNull() | ~F.col("status").isin(*KNOWN_STATUSES), "unknown-status")
        .when(now.isNull() | (now < 0), "invalid-timestamp")
        .when(now < before, "decreasing-timestamp")
        .when((now == before) & (F.col("status") != F.col("__p.status")) & ~tie_ok, "ambiguous-timestamp")
    )
    return rows.withColumn("issue", issue).drop("__p")


def dedupe_inventory(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key with its copy count and whether the copies disagree."""
    variants = rows.groupBy(key, *fields).agg(F.count(F.lit(1)).alias("__n"))
    return variants.groupBy(key).agg(
        F.min(F.struct(*fields)).alias("__row"),
        (F.sum("__n") - F.count(F.lit(1))).alias("duplicates"),
        (F.count(F.lit(1)) > 1).alias("conflicting"),
    ).select(key, "__row.*", "duplicates", "conflicting")


def match_provider(
    canonical: DataFrame, provider: DataFrame, tolerance: int = 900, chunk_rows: int | None = None
) -> DataFrame:
    """Add ``provider_key``: exact timing key, else the unique near session.

    ``canonical``: session_id, season, session_type, scheduled_s, timing_key.
    ``provider``: session_key, season, session_type, start_s.
    """
    by = ["season", "session_type"]
    exact = provider.groupBy(*by, F.col("session_key").alias("timing_key")).agg(
        F.count(F.lit(1)).alias("__exact")
    )
    near = unique_within(
        canonical, provider, by, ["session_id"], "scheduled_s", "start_s", "session_key", tolerance, chunk_rows
    )
    joined = near.join(exact, [*by, "timing_key"], "left")
    key = (
        F.when(F.col("__exact") == 1, F.col("timing_key"))
        .when(F.col("__exact") > 1, F.lit(None))
        .otherwise(F.col("near_session_key"))
    )
    return joined.withColumn("provider_key", key).drop("__exact", "near_session_key", "nearby")


def reconcile(canonical: DataFrame, provider: DataFrame, now_s: int, tolerance: int = 900,
              chunk_rows: int | None = None) -> DataFrame:
    """Provider rows with their reconciliation state.

    ``canonical`` also carries ``state``; ``provider`` carries ``label`` and
    ``is_cancelled``.  A cancelled provider row overrides the matched session.
    """
    matched = match_provider(canonical, provider, tolerance, chunk_rows)
    mapping = matched.where(F.col("provider_key").isNotNull()).groupBy(
        F.col("provider_key").alias("session_key")
    ).agg(
        F.min("session_id").alias("canonical_session_id"),
        F.min_by("state", "session_id").alias("__state"),
        F.count(F.lit(1)).alias("claims"),
    )
    rows = provider.join(mapping, "session_key", "left")
    cancelled = F.coalesce("is_cancelled", F.lit(False))
    state = (
        F.when(F.col("__state").isNotNull() & cancelled & (F.col("__state") != "future"), "cancelled")
        .when(F.col("__state").isNotNull(), F.col("__state"))
        .when(F.lower(F.trim("label")).startswith("day "), "testing")
        .when(cancelled, "cancelled")
        .when(F.col("start_s") >= now_s, "future")
        .otherwise("unmatched-unverified")
    )
    return rows.select(
        *provider.columns, "canonical_session_id", F.coalesce("claims", F.lit(0)).alias("claims"),
        state.alias("reconciliation_state"),
    )


def inventory_summary(sessions: DataFrame) -> DataFrame:
    """Sessions by season, type and state."""
    return sessions.groupBy("season", "session_type", "state").agg(F.count(F.lit(1)).alias("sessions"))


def schedule_inventory(schedule: DataFrame) -> DataFrame:
    """Sessions by season and type; years that failed to load stay visible.

    Rows with a ``failure`` text stand for a year that could not be read.
    """
    return schedule.groupBy("season", "session_type", "failure").agg(
        F.count("session_id").alias("sessions")
    )


def assess_inventory(expected: DataFrame, jobs: DataFrame, published: DataFrame) -> DataFrame:
    """Expected sessions against jobs and publications, one row per identity."""
    e = expected.select("session_id", F.lit(True).alias("expected")).distinct()
    j = jobs.groupBy("session_id").agg(F.max("job_state").alias("job_state"))
    p = published.select("session_id", F.lit(True).alias("published")).distinct()
    full = e.join(j, "session_id", "full").join(p, "session_id", "full")
    no = F.lit(False)
    progress = (
        F.when(F.col("job_state").isNull(), "missing")
        .when(F.col("job_state") == "COMPLETE", "complete")
        .when(F.col("job_state") == "FAILED", "failed")
        .when(F.col("job_state") == "INVALID", "invalid")
        .otherwise("incomplete")
    )
    return full.select(
        "session_id",
        F.coalesce("expected", no).alias("expected"),
        F.coalesce("published", no).alias("published"),
        progress.alias("progress"),
    )


def inventory_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("expected", "published", "progress").agg(F.count(F.lit(1)).alias("sessions"))
