"""Span extraction: dictionaries, drugs with their tails, tests with values; and what is said about a span (negation, history, family)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import ACCENTED, BARE, fold, words
from noteweave.operators.docs import per_text

# What follows a drug or a test, on lower case without accents.
DOSE_TAIL = r"^[ ,]*\d[\d.,]* ?(?:mg|mcg|g|ml|ui|iu|%)(?:/ml)?(?: +(?:po|iv|sc|im|uong|tiem bap|truyen tinh mach|boi ngoai|ngam duoi luoi))?(?: +(?:bid|tid|qd|qhs|q\d+h|prn|moi toi|cach ngay))?"
VALUE = r"^[^0-9.;\n]{0,40}?(\d+(?:[.,]\d+)?(?: ?/ ?\d+)?) ?(mmol/l|µmol/l|mg/l|g/l|u/l|ng/ml|ng/l|miu/l|%|°c|lan/phut|mmhg)?"

#: Dictionaries up to this size go to every task, so the word runs need no exchange.
BROADCAST_ROWS = 50_000


def phrase_table(phrases: DataFrame, phrase: str, entity_type: str, longest: int = 80, alias: str | None = None) -> DataFrame:
    """(key, n, entity_type, canonical): different phrases of 3 to ``longest`` characters as folded word keys.

    With ``alias`` both columns are looked up, and an alias carries its row's
    phrase as canonical. A key that is a phrase itself carries that one.
    """
    column = lambda c: F.col(f"`{c}`")
    keyed = phrases.select(column(phrase).alias("canonical"), column(phrase).alias("p"), F.lit(0).alias("other"))
    if alias:
        keyed = keyed.unionByName(phrases.select(F.coalesce(column(phrase), column(alias)).alias("canonical"), column(alias).alias("p"), F.lit(1).alias("other")))
    keyed = keyed.filter("p is not null").withColumn("w", words(fold(F.lower("p")))).filter(f"size(w) > 0 and length(trim(p)) <= {longest}")
    g = keyed.groupBy(F.array_join("w", " ").alias("key"), F.size("w").alias("n")).agg(F.min(F.struct("other", "canonical")).alias("best"))
    return g.filter("length(key) >= 3").select("key", "n", F.lit(entity_type).alias("entity_type"), F.col("best.canonical").alias("canonical"))


def dictionary_spans(df: DataFrame, id: str, text: str, table: DataFrame) -> DataFrame:
    """(id, start_pos, end_pos, entity_type, canonical, n): every occurrence, overlapping ones too, of every phrase.

    One pass over each text gives its word runs and their offsets; a run is
    emitted only if a phrase of its length begins with its first word, so what
    reaches the join is little more than the result. The first words come from
    the table, which is looked at only while it has ``BROADCAST_ROWS`` phrases or
    less; a larger table is joined without that help, by an exchange of all runs
    of its lengths.
    """
    first = F.split("key", " ")[0]
    sizes = table.groupBy(first.alias("f"), "n").agg(F.count("*").alias("c")).limit(BROADCAST_ROWS + 1).collect()
    begins: dict[str, list[int]] = {}
    lengths: list[int] = []
    if sum(r["c"] for r in sizes) <= BROADCAST_ROWS:
        for r in sizes:
            begins.setdefault(r["f"], []).append(r["n"])
        table = F.broadcast(table)
    else:
        lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # 40 at most: phrases have 80 characters

    def cut(t: str) -> Iterator[tuple]:
        at = [m.span() for m in _WORD.finditer(t)]
        plain = _plain(t)
        key = [plain[a:b] for a, b in at] if len(plain) == len(t) else [_plain(t[a:b]) for a, b in at]
        for i, word in enumerate(key):
            for n in begins.get(word, lengths):
                if i + n <= len(key):
                    yield at[i][0], at[i + n - 1][1], n, " ".join(key[i : i + n])

    runs = per_text(df, id, text, [("start_pos", pa.int32()), ("end_pos", pa.int32()), ("n", pa.int32()), ("key", pa.string())], cut)
    return runs.join(table, ["key", "n"]).select("id", "start_pos", "end_pos", "entity_type", "canonical", "n")


_WORD = re.compile(r"\w+")
_TABLE = str.maketrans(ACCENTED, BARE)


def _plain(word: str) -> str:
    return word.lower().translate(_TABLE)


def with_tail(spans: DataFrame, texts: DataFrame, pattern: str = DOSE_TAIL, reach: int = 80) -> DataFrame:
    """Adds ``tail`` and moves ``end_pos`` over a dose, route and schedule that follow the span."""
    after = fold(F.lower(F.expr(f"substring(text, end_pos + 1, {reach})")))
    d = spans.join(texts.select("id", "text"), "id").withColumn("tail", F.regexp_extract(after, pattern, 0))
    return d.withColumn("end_pos", (F.col("end_pos") + F.length("tail")).cast("int")).drop("text")


def paired_values(spans: DataFrame, texts: DataFrame, reach: int = 60) -> DataFrame:
    """Adds ``value`` and ``unit`` read right after a test's name; empty where none follows."""
    after = fold(F.lower(F.expr(f"substring(text, end_pos + 1, {reach})")))
    d = spans.join(texts.select("id", "text"), "id")
    return d.withColumn("value", F.regexp_extract(after, VALUE, 1)).withColumn("unit", F.regexp_extract(after, VALUE, 2)).drop("text")


def first_token_index(phrases: DataFrame, phrase: str, most: int = 250) -> DataFrame:
    """(first, rank, key): for each first word the longest ``most`` phrases (a top-k index)."""
    keyed = phrases.select(words(fold(F.lower(F.col(f"`{phrase}`")))).alias("w")).filter("size(w) > 0")
    d = keyed.select(F.col("w")[0].alias("first"), F.array_join("w", " ").alias("key")).distinct()
    w = W.partitionBy("first").orderBy(F.length("key").desc(), "key")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("first", "rank", "key")
