"""Pit stop pairing and stint derivation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.operators.scan import CHUNK, KEY, chunked, position, remaining_min, running_sum, scan, series
from lapwing.session import durable

_KEYS = ("session_id", "driver_id")
_ORDER = ("t", "kind", "lap_number", "mark_id")
#: Rows of a batch that a fold sends on.
_BATCH = 8192


def _stack(marks: Iterable[tuple]) -> Iterator[tuple]:
    """lap, entry time, exit time, id, kind, open and n of what marks (t, kind, lap, id, n) of one part, in order, give.

    Marks that repeat are one mark of a larger ``n``.  Open are exits that met no entry and entries that met no exit.
    """
    entries = []
    for (t, kind, lap, mark), same in groupby(marks, key=lambda m: m[:4]):
        n = sum(m[4] for m in same)
        if kind == 0:
            entries.append((t, lap, mark, n))
        elif not entries:
            yield lap, None, t, mark, 1, True, n
        else:
            began, first, entry, _ = entries[-1]
            # An entry without a number of its own stays open.
            if None not in (entry, lap, first) and lap - first in (0, 1):
                entries.pop()
                yield first, began, t, entry, 1, False, n
            else:
                yield lap, None, t, mark, 1, False, n
    for t, lap, mark, n in entries:
        yield lap, t, None, mark, 0, True, n


def _fold(marks: DataFrame) -> DataFrame:
    """What the marks of each (session, driver, part) give: sorted, and folded as a stream over Arrow batches."""
    place = [*_KEYS, "part"]
    stream = marks.select(*place, *_ORDER, "n").repartition(*place).sortWithinPartitions(*place, *_ORDER)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    schema = T.StructType(
        [
            *[T.StructField(c, kinds[c]) for c in (*_KEYS, "lap_number")],
            *[T.StructField(c, kinds["t"]) for c in ("pit_in_time_ms", "pit_out_time_ms")],
            T.StructField("mark_id", T.LongType()), T.StructField("kind", T.IntegerType()),
            T.StructField("open", T.BooleanType()), T.StructField("n", T.LongType()),
        ]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if not types:
                    given = {f.name: f.type for f in batch.schema}
                    types.extend(given[c] for c in (*_KEYS, "lap_number", "t", "t"))
                    types.extend((pa.int64(), pa.int32(), pa.bool_(), pa.int64()))
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(zip(*found, strict=True), types, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=schema.names)

        out = []
        for (session, driver, _), part in groupby(rows(), key=lambda r: r[:3]):
            for found in _stack(r[3:] for r in part):
                out.append((session, driver, *found))
                if len(out) >= _BATCH:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return stream.mapInArrow(fold, schema)


def _unreached(left: DataFrame, rows: int) -> tuple[DataFrame, Column]:
    """Open marks of chunks, and which of them may meet one of another chunk.

    Were every exit to close an entry, open entries would be no more than this; so an entry is reached only where later
    exits bring their number below the entry's own place, and an exit meets something only behind an entry.
    """
    s, entry = series(_KEYS, _ORDER, rows), F.col("kind") == 0
    deep = durable(
        scan(
            left, s, __depth=running_sum(F.when(entry, 1).otherwise(-1).cast("long")),
            __entries=running_sum(F.when(entry, 1).otherwise(0).cast("long")),
        )
    )
    low = durable(scan(deep, s, __low=remaining_min(F.col("__depth"))))
    return low, F.when(entry, F.coalesce(F.col("__low") < F.col("__depth"), F.lit(False))).otherwise(F.col("__entries") > 0)


def pair_pits(marks: DataFrame, ident: str = "event_id", rows: int | None = None) -> DataFrame:
    """Stops from pit entry and exit marks of each (session, driver).

    ``marks``: session_id, driver_id, lap_number, session_time_ms, kind
    (``in``/``out``) and a unique ``ident``.  An exit takes the newest open entry
    if its lap is the entry's or the next one; otherwise it stays partial and the
    entry stays open.  ``rows`` is the size of a chunk of the ordered scans.

    Each chunk of a driver's marks is folded over a stack, as a stream.  Exits that
    met no entry of their chunk and entries left open there are the driver's open
    marks; those that may meet one of another chunk are few and folded once more.
    So there are two passes however deep stops lie within each other.
    """
    todo = marks.select(
        *_KEYS,
        F.col("session_time_ms").alias("t"),
        F.when(F.col("kind") == "in", 0).otherwise(1).alias("kind"),
        F.col("lap_number").cast("int").alias("lap_number"),
        F.col(ident).cast("long").alias("mark_id"),
        F.lit(1).cast("long").alias("n"),
    )
    whole = F.lit(0).cast("long")
    out = [*_KEYS, "lap_number", "pit_in_time_ms", "pit_out_time_ms", "mark_id", "n"]
    if rows is None:
        stops = durable(_fold(todo.withColumn("part", whole))).select(*out)
    else:
        placed = chunked(todo, series(_KEYS, _ORDER, rows)).withColumn("part", F.col(KEY)[CHUNK])
        folded = durable(_fold(placed))
        time = F.coalesce("pit_in_time_ms", "pit_out_time_ms").alias("t")
        left, meets = _unreached(folded.where("open").select(*_KEYS, time, "kind", "lap_number", "mark_id", "n"), rows)
        again = durable(_fold(left.where(meets).withColumn("part", whole)))
        apart = left.where(~meets).withColumns(
            {"pit_in_time_ms": F.when(F.col("kind") == 0, F.col("t")), "pit_out_time_ms": F.when(F.col("kind") == 1, F.col("t"))}
        )
        stops = folded.where(~F.col("open")).select(*out).unionByName(apart.select(*out)).unionByName(again.select(*out))
    each = F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))
    ordered = stops.select(
        *out[:-2], F.col("mark_id").alias("__id"), F.coalesce("pit_in_time_ms", "pit_out_time_ms").alias("__first"), each.alias("__one")
    )
    return scan(ordered, series(_KEYS, ("__first", "lap_number", "__id"), rows), __n=position()).select(
        *_KEYS, F.col("__n").cast("int").alias("stop_number"), "lap_number",
        "pit_in_time_ms", "pit_out_time_ms",
        (F.col("pit_out_time_ms") - F.col("pit_in_time_ms")).alias("pit_lane_duration_ms"),
    )


def derive_stints(laps: DataFrame) -> DataFrame:
    """Stints with inclusive lap bounds; the smallest of conflicting compounds."""
    rows = laps.where(F.col("stint_number").isNotNull())
    return rows.groupBy("session_id", "driver_id", "stint_number").agg(
        F.min("lap_number").alias("start_lap"),
        F.max("lap_number").alias("end_lap"),
        F.min_by("lap_start_time_ms", "lap_number").alias("start_time_ms"),
        F.max_by("lap_end_time_ms", "lap_number").alias("end_time_ms"),
        F.coalesce(F.min("compound"), F.lit("unknown")).alias("compound"),
        (F.min("compound") != F.max("compound")).alias("conflicting_compound"),
        F.min_by("tyre_life_laps", "lap_number").alias("tyre_life_start_laps"),
        F.max_by("tyre_life_laps", "lap_number").alias("tyre_life_end_laps"),
    )
