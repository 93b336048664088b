"""Folded views of a text whose characters know where they come from, and spans carried back to the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.text import strip_accents


def folded_view(df: DataFrame, text: str) -> DataFrame:
    """Adds ``view`` and ``raw_at``: lower case, no accents, runs of white space as one blank; for each of its characters the place in ``text``.

    Built character by character, so marks that stand alone vanish and nothing is
    composed across characters. Null texts have a null view; an empty one is empty.
    """
    chars = F.transform(F.regexp_extract_all(F.col(f"`{text}`"), F.lit("(?s)."), F.lit(0)), lambda c, i: F.struct(c.alias("raw"), i.alias("at")))
    folded = F.filter(F.transform(chars, lambda x: F.struct(F.when(x["raw"].rlike(r"[\s\x{a0}]"), " ").otherwise(strip_accents(F.lower(x["raw"]))).alias("c"), x["at"].alias("at"))), lambda x: x["c"] != "")
    d = df.withColumn("_f", folded)
    kept = F.filter("_f", lambda x, i: (x["c"] != " ") | (i == 0) | (F.get(F.col("_f"), i - 1)["c"] != " "))
    d = d.withColumn("_f", kept)
    return d.withColumn("view", F.array_join(F.col("_f.c"), "")).withColumn("raw_at", F.col("_f.at")).drop("_f")


def to_raw(raw_at: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A view's span as a span of the text."""
    return F.get(raw_at, start), F.get(raw_at, end - 1) + 1


def safe_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets; null where they are no span of it."""
    return F.when((start >= 0) & (start <= end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def slice_differs(text: Column, start: Column, end: Column, span: Column) -> Column:
    """Is a span's text not what stands at its offsets?"""
    return ~F.coalesce(safe_slice(text, start, end) == span, F.lit(False))


def repair_span(text: Column, start: Column, end: Column, span: Column, window: int = 5) -> Column:
    """(start_pos, end_pos) of the one place of ``span`` within ``window`` characters of where it should be; null if there is none or several."""
    low = F.greatest(F.lit(0), start - window)
    high = F.least(F.length(text), end + window)
    part = F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))
    first = F.position(span, part)
    again = F.position(span, F.substring(part, first + 1, F.length(part)))
    found = F.struct((low + first - 1).alias("start_pos"), (low + first - 1 + F.length(span)).alias("end_pos"))
    return F.when((F.length(span) > 0) & (first > 0) & (again == 0), found)


def context(text: Column, start: Column, end: Column, window: int) -> tuple[Column, Column]:
    """The text before and after a span, up to ``window`` characters."""
    low = F.greatest(F.lit(0), start - window)
    return F.substring(text, low + 1, start - low), F.substring(text, end + 1, F.lit(window))


def sentence_around(text: Column, start: Column, end: Column, radius: int = 80) -> Column:
    """A span with what stands around it in its sentence, up to ``radius`` characters."""
    left, right = context(text, start, end, radius)
    return F.concat(F.regexp_extract(left, r"([^.!?\n\r]*)$", 1), F.substring(text, start + 1, end - start), F.regexp_extract(right, r"^[^.!?\n\r]*", 0))


def trimmed(text: Column, start: Column, end: Column, edge: str) -> tuple[Column, Column]:
    """A span without characters of a class at its ends; ``edge`` is the inside of a bracket expression."""
    span = F.substring(text, start + 1, end - start)
    left = F.length(F.regexp_extract(span, f"^[{edge}]*", 0))
    right = F.length(F.regexp_extract(span, f"([{edge}]*)$", 1))
    return F.least(start + left, end), F.greatest(end - right, F.least(start + left, end))
