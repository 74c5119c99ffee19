"""Personal data in whole texts, with DataFrame functions only.

Patterns propose spans, checksums confirm them (Luhn for cards, mod-97 for bank accounts), and words near a span move
its score.  A pattern is applied twice, to extract and to split, and the lengths of what it returns give the positions.
Patterns are possessive and begin where a run begins or the last match ended: they find what the plain forms find, in
linear time and without recursion.  An account number is proposed by its head alone, with the text that follows, and
the checksum decides among the ends of its groups, the longest first: what follows a number never belongs to it unless
the checksum says so.

Positions, and the text around a span, cost the same for every match however many a text has: found spans are gathered
in short runs, and what is near a span is cut from a piece of the text, not counted from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this holds no match.
    needs: str
    #: Score of a confirmed span, and the words near it that raise it.
    score: float
    words: str


# Patterns, in the order in which kinds are listed; the first four are the base.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, "mail|contact|write|reply",
    ),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", "", 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, "tel|phone|call|mobile|fax"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]{4}){2}(?s:.{0,32})))",
        "", 0.9, "iban|bank|account|konto|compte|cuenta",
    ),
)
BASE = 4
#: Forms of an account number at the head of what is proposed, the longest first.
ACCOUNTS = tuple(
    rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{rest}(?![A-Za-z0-9])"
    for groups in range(7, 1, -1)
    for rest in (" ?[A-Z0-9]{1,3}", "")
)
#: Characters on each side in which words count, and what a word adds.
NEAR, WORD_WORTH = 40, 0.1
#: Matches gathered in a run, and characters in a piece of a text.
RUN, PIECE = 128, 1024
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _parts(text: Column, kind: Kind) -> Column:
    """What lies before each match, and the match; null where the text can hold none."""
    parts = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit")
    )
    return F.when(text.contains(kind.needs), parts) if kind.needs else parts


def _fold(items: str, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` finds in the array column ``items``, from one item to the next.

    ``step`` takes and gives (at, found).  Found items are gathered run by run and the runs put together at the end:
    adding to one long array would copy it for every item.
    """
    none = F.array().cast("array<struct<start:int,value:string>>")
    runs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(items) / F.lit(RUN)).cast("int")),
        lambda run: F.slice(items, run * RUN + 1, F.lit(RUN)),
    )

    def over(done: Column, run: Column) -> Column:
        begin = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))
        return F.array_append(done, F.aggregate(run, F.struct(begin.alias("at"), none.alias("found")), step))

    first = F.array().cast("array<struct<at:int,found:array<struct<start:int,value:string>>>>")
    return F.flatten(F.transform(F.aggregate(runs, first, over), lambda run: run["found"]))


def _place(done: Column, part: Column) -> Column:
    """Adds (start, value) of one match; its start is the length of all that comes before."""
    start = done["at"] + F.char_length(part["gap"])
    return F.struct(
        (start + F.coalesce(F.char_length(part["hit"]), F.lit(0))).alias("at"),
        F.when(part["hit"].isNull(), done["found"])
        .otherwise(F.array_append(done["found"], F.struct(start.alias("start"), part["hit"].alias("value"))))
        .alias("found"),
    )


def _cut(pieces: str, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` of the text that ``pieces`` holds, without counting from its beginning."""
    at = F.floor(start / F.lit(PIECE)).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    return F.substr(two, start % PIECE + 1, size)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _byte_range(value: Column) -> Column:
    """Whether the four parts are at most 255; leading zeros don't count."""
    small = lambda part: F.char_length(F.regexp_replace(part, "^0+(?=[0-9])", "")) <= 3
    low = lambda part: F.when(small(part), F.regexp_replace(part, "^0+(?=[0-9])", "").cast("int") <= 255)
    return F.forall(F.split(value, r"\."), lambda part: F.coalesce(low(part), F.lit(False)))


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def step(total: Column, place: Column) -> Column:
        digit = F.substr(turned, place, F.lit(1)).cast("int")
        twice = digit * 2
        even = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when(place % 2 == 0, even).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step)
    return total % 10 == 0


def mod97(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, place: Column) -> Column:
        char = F.substr(turned, place, F.lit(1))
        letter = F.instr(F.lit(LETTERS), char)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise((rest * 10 + char.cast("int")) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), step) == 1


def _confirmed(name: str, value: Column) -> Column:
    if name == "ip":
        return _byte_range(value)
    if name == "card":
        size = F.char_length(_digits(value))
        return size.between(13, 19) & luhn(_digits(value))
    if name == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _account(proposed: Column) -> Column:
    """The longest account number that a proposal begins with; null if none."""
    forms = F.array(*[F.regexp_extract(proposed, form, 0) for form in ACCOUNTS])
    size = lambda value: F.char_length(F.replace(value, F.lit(" "), F.lit("")))
    return F.get(F.filter(forms, lambda value: size(value).between(15, 34) & mod97(value)), F.lit(0))


def _free(done: Column, one: Column) -> Column:
    """Adds an account number unless it begins inside the one before."""
    free = one["start"] >= done["at"]
    return F.struct(
        F.when(free, one["start"] + F.char_length(one["value"])).otherwise(done["at"]).alias("at"),
        F.when(free, F.array_append(done["found"], one)).otherwise(done["found"]).alias("found"),
    )


def _with_accounts(rows: DataFrame, kind: Kind) -> DataFrame:
    """Account numbers in place of the heads that were matched; one that begins inside another is not counted."""
    ahead = F.regexp_extract_all(F.col("text"), F.lit(kind.pattern), F.lit(1))
    proposed = F.zip_with(
        f"__{kind.name}", ahead,
        lambda head, rest: F.struct(head["start"].alias("start"), _account(F.concat(head["value"], rest)).alias("value")),
    )
    good = rows.withColumn(f"__{kind.name}", F.filter(proposed, lambda one: one["value"].isNotNull()))
    return good.withColumn(f"__{kind.name}", _fold(f"__{kind.name}", _free))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``found``: (kind, start, end, score) of every span, by kind as listed and then by start.

    Null and empty texts have none.  Null and repeated ids pass through; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumns({f"__{kind.name}": _parts(F.col("text"), kind) for kind in KINDS})
    rows = rows.withColumns({f"__{kind.name}": _fold(f"__{kind.name}", _place) for kind in KINDS})
    rows = _with_accounts(rows, KINDS[BASE])
    rows = rows.withColumn("__pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))

    def spans(kind: Kind) -> Column:
        def span(match: Column) -> Column:
            end = match["start"] + F.char_length(match["value"])
            before = F.greatest(match["start"] - NEAR, F.lit(0))
            near = F.concat(
                _cut("__pieces", before, match["start"] - before), F.lit(" "), _cut("__pieces", end, F.lit(NEAR))
            )
            worth = F.when(near.rlike(f"(?i)(?<![A-Za-z])(?:{kind.words})"), kind.score + WORD_WORTH)
            return F.struct(
                F.lit(kind.name).alias("kind"), match["start"].alias("start"), end.alias("end"),
                F.least(worth.otherwise(kind.score), F.lit(1.0)).alias("score"),
            )

        good = F.filter(f"__{kind.name}", lambda match: _confirmed(kind.name, match["value"]))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
        return F.coalesce(F.transform(good, span), none)

    return rows.select("id", F.concat(*[spans(kind) for kind in KINDS]).alias("found"))


def spans_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The columns of the query, and the scores of the spans."""
    base = [kind.name for kind in KINDS[:BASE]]
    found = find_pii(docs)
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(name).alias(f"n_{name}") for name in base],
        F.sha2(spans_text(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
