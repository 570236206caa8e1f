"""Swim times: text and whole milliseconds. Fractions are cut to hundredths, hours count as minutes; floats are never used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions.text import blank_to_null

# Words that stand in place of a time.
TEXT_STATUSES = ("DNS", "DNF", "DSQ", "SCRATCH", "NT", "NS", "DQ", "DFS", "VALID", "UNKNOWN")
#: Digits allowed in the first number of a clock with one, two or three numbers; further ones have two.
FIRST_DIGITS = (3, 3, 2)
#: A clock of minutes, seconds and hundredths, as nearly all times are printed: read by its places, without the reader of other forms.
PLAIN = r"^(?:0|[1-9][0-9]{0,2}):[0-9]{2}[.,][0-9]{2}\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clock(text: Column) -> Column:
    """(minutes, seconds, centis, n: numbers on the clock) that a time's text shows; null where it shows none.

    The text is one row of digit groups: parted by colons, with a fraction behind a point, comma or the last apostrophe.
    """
    plain = F.regexp_replace(F.upper(F.trim(F.regexp_replace(text, "^[Xx]", ""))), r"(?<=\d)[A-Z]$", "")
    quoted = lambda t: F.when(t.rlike(r"^\d+(?:'\d\d)?'\d{1,2}$"), F.translate(F.regexp_replace(t, "'(?=\\d+$)", "."), "'", ":")).otherwise(F.translate(t, ",", "."))
    halves = F.split(let(plain, quoted), r"\.", -1)
    parts = let(halves, lambda h: F.struct(F.split(F.get(h, F.lit(0)), ":", -1).alias("groups"), F.coalesce(F.get(h, F.lit(1)), F.lit("0")).alias("fraction"), F.size(h).alias("halves")))

    def read(p: Column) -> Column:
        groups, fraction, n = p["groups"], p["fraction"], F.size(p["groups"])
        first = F.get(groups, F.lit(0))
        begins = first.rlike("^[0-9]+$") & (F.length(first) <= F.get(F.array(*map(F.lit, FIRST_DIGITS)), n - 1))
        rest = F.forall(F.slice(groups, 2, 3), lambda g: g.rlike("^[0-9]{2}$"))
        well = (n <= len(FIRST_DIGITS)) & (p["halves"] <= 2) & begins & rest & fraction.rlike("^[0-9]+$") & ((n == 3) | (F.length(fraction) <= 6))
        upto = F.aggregate(F.slice(groups, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, g: a * 60 + g.try_cast("long"))
        shown = F.struct(upto.alias("minutes"), F.element_at(groups, -1).try_cast("long").alias("seconds"), F.rpad(F.substring(fraction, 1, 2), 2, "0").try_cast("long").alias("centis"), n.alias("n"))
        return F.when(well, shown)

    return let(parts, read)


def normal_time(text: Column) -> Column:
    """`m:ss,cc` or `s,cc`, with X before exhibition times; status words in capitals; other text as it is."""

    def shown(value: Column, t: Column) -> Column:
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        seconds = F.when((t["n"] == 2) | (t["minutes"] > 0), F.concat(t["minutes"].cast("string"), F.lit(":"), two(t["seconds"]))).otherwise(t["seconds"].cast("string"))
        return F.concat(F.when(F.upper(value).startswith("X"), "X").otherwise(""), seconds, F.lit(","), two(t["centis"]))

    def of(value: Column) -> Column:
        return F.coalesce(F.when(F.upper(value).isin(*TEXT_STATUSES), F.upper(value)), let(_clock(value), lambda t: shown(value, t)), value)

    return F.when(text.rlike(PLAIN), F.translate(text, ".", ",")).when(text.isNotNull(), let(blank_to_null(text), of))


def time_ms(text: Column) -> Column:
    """Milliseconds of a time, null for status words, other text and over 999 minutes."""
    number = lambda c: c.cast("long")
    plain = (number(F.substring_index(text, ":", 1)) * 60 + number(F.substring(text, -5, 2))) * 1000 + number(F.substring(text, -2, 2)) * 10
    other = let(_clock(blank_to_null(text)), lambda t: F.when(t["minutes"] < 1000, (t["minutes"] * 60 + t["seconds"]) * 1000 + t["centis"] * 10))
    return F.when(text.rlike(PLAIN), plain).when(text.isNotNull(), other)


def format_ms(ms: Column) -> Column:
    """`m:ss,cc`."""
    return F.concat((ms / 60000).cast("long").cast("string"), F.lit(":"), F.lpad(((ms % 60000) / 1000).cast("long").cast("string"), 2, "0"), F.lit(","), F.lpad(((ms % 1000) / 10).cast("long").cast("string"), 2, "0"))


def seed_delta_seconds(result_ms: Column, seed_ms: Column) -> Column:
    """Result less seed in seconds, two decimals; null where either is null or 0."""
    return F.round((F.nullif(result_ms, F.lit(0)) - F.nullif(seed_ms, F.lit(0))).cast("decimal(18,3)") / 1000, 2).cast("decimal(12,2)")
