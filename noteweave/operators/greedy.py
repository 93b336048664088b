"""Greedy one-to-one choices and order-dependent resolutions, one fold over each text's sorted array, inside the JVM.

A text's spans or pairs meet in one task: what is gathered is bounded by one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_to_one(pairs: DataFrame, order: list[Column], left: str, right: str) -> DataFrame:
    """The pairs that stay when taken by ``order``, each side's members once. ``pairs``: id, numbers ``left`` and ``right`` within the text, anything else.

    Ties beyond ``order`` go to the smaller ``left``, then ``right``.
    """
    key = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.col(left).alias("_l"), F.col(right).alias("_r"))
    g = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*(c for c in pairs.columns if c != "id")).alias("v")))).alias("s"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("l"), none.alias("r"), F.filter(F.col("s"), lambda x: F.lit(False)).alias("out"))
    free = lambda acc, x: ~F.array_contains(acc["l"], x["k"]["_l"]) & ~F.array_contains(acc["r"], x["k"]["_r"])
    take = lambda acc, x: F.struct(F.array_append(acc["l"], x["k"]["_l"]).alias("l"), F.array_append(acc["r"], x["k"]["_r"]).alias("r"), F.array_append(acc["out"], x).alias("out"))
    kept = F.aggregate("s", start, lambda acc, x: F.when(free(acc, x), take(acc, x)).otherwise(acc), lambda acc: acc["out"])
    return g.select("id", F.explode(kept).alias("x")).select("id", "x.v.*")


def fold_kept(spans: DataFrame, order: list[Column], clash: Callable[[Column, Column], Column]) -> DataFrame:
    """The spans that stay when taken by ``order``, one left out if it clashes with any kept before."""
    columns = [c for c in spans.columns if c != "id"]
    key = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)))
    g = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*columns).alias("v")))).alias("s"))
    kept = F.aggregate("s", F.filter(F.col("s"), lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: clash(y["v"], x["v"])), acc).otherwise(F.array_append(acc, x)))
    return g.select("id", F.explode(kept).alias("x")).select("id", "x.v.*")


def numbered(spans: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each span's number within its text, from 0."""
    from pyspark.sql import Window as W

    return spans.withColumn(name, (F.row_number().over(W.partitionBy("id").orderBy(*order)) - 1).cast("int"))
