"""Strings, numbers held as text, coordinates typed by people, seeded keys."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# a typed coordinate is read as tokens: numbers, words with their punctuation, single marks
TOKEN = r"[-+]?[0-9]+(?:[.][0-9]+)?|[a-z]+(?:\s*[.:=])*|\S"
KINDS = {"lat": "A", "lon": "O", "lng": "O", "long": "O", "n": "v", "s": "v", "e": "h", "w": "h", ",": ",", ";": ",", "/": ","}
# latitude, then longitude; labels, hemispheres and the mark between them may each be left out
PAIRS = tuple("".join(x) for x in product(("A", ""), "#", ("v", ""), (",", ""), ("O", ""), "#", ("h", "")))


def clean_category(c: Column) -> Column:
    return F.lower(F.trim(c))


def clean_title(c: Column) -> Column:
    """Hyphens to spaces, runs of blanks collapsed, each word capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(c, "-", " "), r"\s+", " ")))


def shorten(c: Column, width: int = 160) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def to_positive_number(c: Column) -> Column:
    """Text to number; anything unreadable or not above zero is NULL."""
    v = c.try_cast("double")
    return F.when(v > 0, v)


def parse_coords(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of a typed pair, NULL where it is not one.

    Two decimal numbers in either order of size (the first is the latitude unless only the
    other can be). Each may carry a label (lat; lon, lng or long), a sign, a degree mark and a
    hemisphere letter, in any case; S and W make it negative. Between them may stand blanks
    and one comma, semicolon or slash. Anything else in the text makes it no coordinate.
    """
    raw = F.regexp_extract_all(F.lower(F.replace(text, F.lit("°"), F.lit(" "))), F.lit(TOKEN), F.lit(0))
    tokens = F.transform(raw, lambda t: F.regexp_replace(t, r"([a-z])[\s.:=]*$", "$1"))
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = lambda t: F.when(t.rlike("[0-9]"), "#").otherwise(F.coalesce(F.try_element_at(named, t), F.lit("?")))
    numbers = F.filter(tokens, lambda t: t.rlike("[0-9]"))
    a, b = (F.get(numbers, i).try_cast("double") for i in (0, 1))
    south, west = F.array_contains(tokens, "s"), F.array_contains(tokens, "w")
    first, second = F.when(south, -F.abs(a)).otherwise(a), F.when(west, -F.abs(b)).otherwise(b)
    swap = (F.abs(first) > 90) & (F.abs(second) <= 90)
    lat, lon = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
    ok = F.array_join(F.transform(tokens, kind), "").isin(*PAIRS) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(ok, lat), F.when(ok, lon)


def seeded_key(seed: int | str, *cols: Column | str) -> Column:
    """A reproducible pseudo-random hex key per row, the same in any SQL engine."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def seeded_uniform(seed: int | str, *cols: Column | str) -> Column:
    """Uniform in [0, 1) from the first eight hex digits of :func:`seeded_key`."""
    head = F.conv(F.substring(seeded_key(seed, *cols), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
