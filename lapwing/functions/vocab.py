"""Controlled vocabularies and the parsers that map raw labels onto them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw label (lower case, single spaces) -> canonical value.
TYRE_COMPOUNDS = {
    "unknown": "unknown",
    "soft": "soft",
    "medium": "medium",
    "hard": "hard",
    "intermediate": "intermediate",
    "wet": "wet",
}
DRIVER_STATUSES = {
    "running": "running",
    "active": "running",
    "finished": "finished",
    "classified": "finished",
    "retired": "retired",
    "disqualified": "disqualified",
    "dsq": "disqualified",
    "did not start": "did-not-start",
    "dns": "did-not-start",
    "did not finish": "did-not-finish",
    "dnf": "did-not-finish",
    "not classified": "not-classified",
    "nc": "not-classified",
}
TRACK_STATUSES = {
    "1": "clear",
    "all clear": "clear",
    "clear": "clear",
    "2": "yellow",
    "yellow": "yellow",
    "yellow flag": "yellow",
    "4": "safety-car",
    "safety car": "safety-car",
    "sc": "safety-car",
    "5": "red-flag",
    "red": "red-flag",
    "red flag": "red-flag",
    "6": "virtual-safety-car",
    "virtual safety car": "virtual-safety-car",
    "vsc": "virtual-safety-car",
    "7": "vsc-ending",
    "vsc ending": "vsc-ending",
}
SESSION_TYPES = {
    "fp1": "practice-1",
    "p1": "practice-1",
    "practice 1": "practice-1",
    "free practice 1": "practice-1",
    "fp2": "practice-2",
    "p2": "practice-2",
    "practice 2": "practice-2",
    "free practice 2": "practice-2",
    "fp3": "practice-3",
    "p3": "practice-3",
    "practice 3": "practice-3",
    "free practice 3": "practice-3",
    "q": "qualifying",
    "qualifying": "qualifying",
    "ss": "sprint-shootout",
    "sprint shootout": "sprint-shootout",
    "sq": "sprint-qualifying",
    "sprint qualifying": "sprint-qualifying",
    "s": "sprint",
    "sprint": "sprint",
    "r": "race",
    "race": "race",
}
DATA_QUALITIES = {
    "unknown": "unknown",
    "complete": "complete",
    "partial": "partial",
    "degraded": "degraded",
    "invalid": "invalid",
}
DRY_COMPOUNDS = ("soft", "medium", "hard")
TERMINAL_STATUSES = ("retired", "finished", "dns", "dsq")


def token(c: Column) -> Column:
    """Lower case, ``_``/``-`` as spaces, whitespace collapsed."""
    spaced = F.regexp_replace(F.lower(c), "[_\\-]", " ")
    return F.trim(F.regexp_replace(spaced, "\\s+", " "))


def parse_enum(c: Column, aliases: dict[str, str], unknown: str = "unknown") -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(mapping, token(c)), F.lit(unknown))


def driver_status(code: Column, raw: Column) -> Column:
    """Status from the one-letter classification code, else from the raw text."""
    letter = F.upper(F.trim(code))
    mapped = parse_enum(raw, DRIVER_STATUSES)
    return (
        F.when(letter == "R", "retired")
        .when(letter.isin("D", "E"), "disqualified")
        .when(letter == "W", "did-not-start")
        .when(letter.isin("F", "N"), "not-classified")
        .when(mapped != "unknown", mapped)
        .when(F.trim(raw).rlike("(?i)^\\+\\s*\\d+\\s+laps?$"), "finished")
        .otherwise("unknown")
    )


def session_type(year: Column, label: Column) -> Column:
    """Canonical session type; one label changed meaning between seasons."""
    label_token = F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "_", " "), "\\s+", " "))
    sprint_qualifying = label_token == "sprint qualifying"
    return (
        F.when((year == 2021) & sprint_qualifying, "sprint")
        .when((year == 2023) & sprint_qualifying, "sprint-shootout")
        .otherwise(parse_enum(label, SESSION_TYPES))
    )


def outcome(status: Column, classified: Column, laps_completed: Column) -> Column:
    """Race outcome category; the first matching rule wins."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    non_start = (
        text.contains("did not start")
        | text.contains("did not qualify")
        | text.contains("did not prequalify")
        | text.contains("not started")
    )
    # Zero-lap reasons that count as not having started.
    withdrawn = text.isin(
        "withdrew", "injury", "injured", "illness", "safety", "safety concerns"
    ) | text.startswith("withdraw")
    return (
        F.when(text.contains("disqual") | text.contains("excluded"), "dsq")
        .when(text == "finished", "finished")
        .when(F.coalesce(classified, F.lit(False)) | (text.startswith("+") & text.contains("lap")), "classified")
        .when(non_start | ((F.coalesce(laps_completed, F.lit(0)) == 0) & withdrawn), "dns")
        .when(text != "", "dnf")
        .otherwise("other")
    )


def decode(c: Column, mapping: dict, default: str = "UNKNOWN") -> Column:
    """Map a code through the caller's table, unknown codes stay unknown."""
    if not mapping:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, c), F.lit(default))


def stratum(season: Column, kind: Column) -> Column:
    """Era and category label used to stratify storage samples."""
    era = (
        F.when(season <= 2020, "2018-2020").when(season <= 2023, "2021-2023").otherwise("2024-current")
    )
    category = F.when(
        kind.isin("sprint-qualifying", "sprint-shootout"), "sprint-qualifying-shootout"
    ).otherwise(kind)
    return F.concat_ws("/", era, category)
