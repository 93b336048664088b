"""Training samples made, changed and audited: templates with marked entities, noise that keeps offsets, hashes, leakage, similar texts."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.functions.text import fold


def unmark(marked: Column) -> tuple[Column, Column]:
    """The plain text of a marked one (``[[E0]]…[[/E0]]``), and its spans as an array of (no, start_pos, end_pos).

    Pieces between marks alternate: outside, inside, outside; entities don't nest.
    """
    pieces = F.split(marked, r"\[\[/?E\d+\]\]", -1)
    numbers = F.regexp_extract_all(marked, F.lit(r"\[\[E(\d+)\]\]"), F.lit(1))
    upto = lambda n: F.aggregate(F.slice(pieces, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    spans = F.transform(numbers, lambda no, i: F.struct(no.cast("int").alias("no"), upto(2 * i + 1).alias("start_pos"), upto(2 * i + 2).alias("end_pos")))
    return F.array_join(pieces, ""), spans


def fill_templates(concepts: DataFrame, templates: DataFrame) -> DataFrame:
    """(sample_id, template_id, text, spans): every concept (concept_id, surface, kind) in every template (template_id, kind, pattern) of its kind; ``{0}`` is the marked place."""
    d = concepts.join(templates, "kind")
    marked = F.replace("pattern", F.lit("{0}"), F.concat(F.lit("[[E0]]"), "surface", F.lit("[[/E0]]")))
    text, spans = unmark(marked)
    return d.select(F.concat_ws("_", F.lit("syn"), "template_id", "concept_id").alias("sample_id"), "template_id", text.alias("text"), spans.alias("spans"))


NOISES = ["no_diacritics", "missing_space", "repeated_token", "dropped_vowel"]
_LETTER = r"[A-Za-zÀ-ỹĐđ]"


def noisy(c: Column, kind: str) -> Column:
    """A piece of text with one kind of noise."""
    if kind == "no_diacritics":
        return fold(c)
    if kind == "missing_space":
        at = F.position(F.lit(" "), c)
        return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c)))).otherwise(c)
    if kind == "repeated_token":
        return F.regexp_replace(c, rf"^([^A-Za-zÀ-ỹĐđ]*(?:{_LETTER}[^A-Za-zÀ-ỹĐđ]+)*)({_LETTER}{{2,}})", "$1$2$2")
    return F.regexp_replace(c, rf"^(.*?{_LETTER})[aeiouyăâêôơưAEIOUYĂÂÊÔƠƯ](?={_LETTER})", "$1")


def add_noise(samples: DataFrame, number: str) -> DataFrame:
    """(id, noise, text, spans): each text with the noise of its number modulo 4, piece by piece, so spans keep their text.

    ``samples``: id, text, entities (start_pos, end_pos, without overlaps), a number.
    """
    es = F.array_sort(F.transform("entities", lambda e: F.struct(e["start_pos"].alias("s"), e["end_pos"].alias("e"))))
    d = samples.select("id", "text", es.alias("es"), F.element_at(F.array(*map(F.lit, NOISES)), (F.col(number) % 4 + 1).cast("int")).alias("noise"))
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform("es", lambda x: F.array(x["s"], x["e"]))), F.array(F.length("text")))
    d = d.withColumn("_b", bounds)
    pieces = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda i: F.substring("text", F.element_at("_b", i) + 1, F.element_at("_b", i + 1) - F.element_at("_b", i)))

    def with_noise(kind: str) -> Column:
        return F.transform(pieces, lambda p: noisy(p, kind))

    changed = F.lit(None).cast("array<string>")
    for kind in NOISES:
        changed = F.when(F.col("noise") == kind, with_noise(kind)).otherwise(changed)
    d = d.withColumn("_p", changed)
    upto = lambda n: F.aggregate(F.slice("_p", F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    spans = F.transform("es", lambda e, i: F.struct(upto(2 * i + 1).alias("start_pos"), upto(2 * i + 2).alias("end_pos")))
    return d.select("id", "noise", F.array_join("_p", "").alias("text"), spans.alias("spans"))


def dataset_hash(samples: DataFrame, columns: list[str], parts: int = 64) -> DataFrame:
    """(rows, hash): a hash of all rows that does not depend on their order or partitioning.

    Row hashes are summed in ``parts`` pieces before they meet.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    d = samples.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)").alias("h"), F.pmod(F.xxhash64(row), F.lit(parts)).alias("p"))
    g = d.groupBy("p").agg(F.sum("h").alias("h"), F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").cast("string"), 256).alias("hash"))


def first_of_each(samples: DataFrame, by: str, order: str) -> DataFrame:
    """The first sample of each value of ``by``: a pilot set."""
    w = W.partitionBy(by).orderBy(order)
    return samples.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def label_distribution(samples: DataFrame, by: str) -> DataFrame:
    """(by, entity_type, n): how many entities of each type."""
    return samples.select(by, F.explode("entities.entity_type").alias("entity_type")).groupBy(by, "entity_type").agg(F.count("*").alias("n"))


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def match_ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all, matches being the longest common blocks taken recursively; nulls count as empty."""
    return _ratio(a, b)
