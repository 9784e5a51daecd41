"""Column functions that clean and name values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_null(text: Column) -> Column:
    """A finite number, or null for anything else."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cell_number(text: Column) -> Column:
    """A report cell as a number: a trailing % or m goes, empty cells and 0.0% are missing."""
    bare = F.trim(text)
    return F.when((bare != "") & (bare != "0.0%"), number_or_null(F.regexp_replace(bare, "[%m]$", "")))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def handle_key(name: Column) -> Column:
    """What two spellings of one handle share: lower-case letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def season_year(day: Column) -> Column:
    """The season a day belongs to: from October on, the next year's."""
    return (F.year(day) + (F.month(day) >= 10).cast("int")).cast("int")


def age_in_years(birth: Column, day: Column) -> Column:
    return F.datediff(day, birth).cast("double") / 365.25


def trigrams(text: Column) -> Column:
    """The different three-letter pieces of a text's words, each word with two blanks in front and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts; null if neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))
