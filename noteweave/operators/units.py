"""Quantities written in different units and scales, brought to common units.

Reading a quantity is one chain of built-in expressions: the first strength in
the text (number, unit, volume it is dissolved in), else a bare number with the
unit of the column, else the column's value; the number is read with the decimal
mark of its source. Units turn into a factor and a common unit by a table.

A number without any unit is in its source's default unit, but a source may
change its scale one day without saying so. So the history of each source's
unmarked numbers is segmented: log values are averaged by day (at most one row
per source and day, however many records), and the least-cost segmentation under
a penalty per change is found exactly by dynamic programming. A shift between
segments that matches a known factor between units marks a change, which is
reversed: values go back to the scale of the source's longest segment.

Null text or columns are missing statements; a record that states no quantity
has a null amount. Quantities per body weight, in milliequivalents or in counted
pieces have no common unit and a null amount.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.session import cut_lineage

# Unit names and their factor to the common unit.
MASS = {"mcg": 0.001, "µg": 0.001, "μg": 0.001, "ug": 0.001, "micrograms": 0.001, "microgram": 0.001, "microgam": 0.001, "mg": 1.0, "mgs": 1.0, "milligrams": 1.0, "milligram": 1.0, "miligram": 1.0, "miligam": 1.0, "g": 1000.0, "gm": 1000.0, "gr": 1000.0, "gam": 1000.0, "gram": 1000.0, "grams": 1000.0, "kilogram": 1e6}
VOLUME = {"ml": 1.0, "cc": 1.0, "l": 1000.0, "lít": 1000.0, "lit": 1000.0, "dl": 100.0}
ACTIVITY = {"unt": 1.0, "units": 1.0, "unit": 1.0, "iu": 1.0, "ui": 1.0, "đv": 1.0, "dv": 1.0, "đơn vị": 1.0, "don vi": 1.0, "đvqt": 1.0, "miu": 1e6}
TIMES = {"nghìn": 1e3, "nghin": 1e3, "ngàn": 1e3, "triệu": 1e6, "trieu": 1e6, "million": 1e6}
PIECES = "viên vien ống ong giọt giot nhát gói goi lọ lo chai miếng mieng tablets tablet tabs puffs puff drops".split()
PIECES = [*PIECES, "nhát xịt", "nhat xit"]
#: Ratios between scales that a change of unit can make: those within each table, 10 and 100 among them.
KNOWN_FACTORS = tuple(sorted({10.0 ** round(math.log10(a / b)) for t in (MASS, VOLUME, ACTIVITY) for a in t.values() for b in t.values() if a != b}))

NUMBER = r"\d+(?:[.,]\d+)*"


def _any(names: list[str]) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


_UNITS = _any([*MASS, *VOLUME, *ACTIVITY, "meq", "%"])
STRENGTH = rf"(?<![\p{{L}}\d.,])({NUMBER})\s*(?:({_any(list(TIMES))})\s*)?({_UNITS})(?![\p{{L}}\d])\.?(?:\s*(?:/|trong)\s*({NUMBER})?\s*(ml|cc|l|dl|kg|m2|m²)(?![\p{{L}}\d]))?"
BARE = rf"(?<![\p{{L}}\d.,/])({NUMBER})(?![\p{{L}}\d%])"
LEADING_COUNT = rf"^\s*(?:x\s*{NUMBER}(?![\p{{L}}\d])|{NUMBER}\s*(?:{_any(PIECES)})(?!\p{{L}}))"
COUNTED = rf"(?<![\p{{L}}\d.,])({NUMBER})\s*(?:{_any(PIECES)})(?!\p{{L}})"
SCHEDULE = r"(?:(?:sáng|trưa|chiều|tối|sang|trua|chieu|toi)\s*\d+\s*)+|(?:ngày|ngay)\s*\d+\s*(?:lần|lan)|\d+\s*(?:lần|lan)(?:\s*/\s*(?:ngày|ngay))?|q\d+h"
COLUMN_UNIT = rf"^\s*(?:({_any(list(TIMES))})\s*)?({_UNITS})?\.?\s*(?:/\s*({NUMBER})?\s*(ml|cc|l|dl|kg|m2|m²))?(?:/\p{{L}}+)?\s*\.?\s*$"


def _lookup(table: dict[str, float], c: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[c]


def parse_number(c: Column, decimal_mark: Column) -> Column:
    """A number read with its decimal mark; the other mark groups thousands."""
    comma = F.coalesce(decimal_mark, F.lit(".")) == ","
    plain = F.when(comma, F.translate(F.replace(c, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(c, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def _unit_and_factor(times: Column, unit: Column, per: Column, volume: Column, mark: Column) -> tuple[Column, Column]:
    """The common unit and the factor to it; null for a unit without one."""
    many = F.coalesce(_lookup(TIMES, times), F.lit(1.0))
    plain = volume == ""
    kind = (
        F.when(volume.isin("kg", "m2", "m²"), None)
        .when((unit == "%") & plain, "MG/ML")
        .when(_lookup(MASS, unit).isNotNull(), F.when(plain, "MG").otherwise("MG/ML"))
        .when(plain & _lookup(ACTIVITY, unit).isNotNull(), "UNT")
        .when(plain & _lookup(VOLUME, unit).isNotNull(), "ML")
        .when(plain & (unit == "") & (times != ""), "UNT")
    )
    size = F.coalesce(_lookup(MASS | VOLUME | ACTIVITY | {"%": 10.0}, unit), F.lit(1.0))
    per_ml = F.coalesce(parse_number(per, mark), F.lit(1.0)) * F.coalesce(_lookup(VOLUME, volume), F.lit(1.0))
    return kind, many * size / F.when(per_ml > 0, per_ml)


def read_quantities(df: DataFrame, sources: DataFrame, text: str, value: str, unit: str, source: str) -> DataFrame:
    """Adds ``q_number``, ``q_unit``, ``q_factor`` and ``q_bare`` (no unit stated anywhere).

    ``sources`` (source, default_unit, decimal_mark) is a small table of fixed
    size, one row per source; how it is joined is left to the size Spark sees.
    """
    rules = sources.select(F.col("source").alias("_s"), F.col("default_unit").alias("_default"), F.col("decimal_mark").alias("_mark")).dropDuplicates(["_s"])
    d = df.join(rules, F.col(f"`{source}`") == F.col("_s"), "left").drop("_s")
    low = F.lower(F.regexp_replace(F.col(f"`{text}`"), r"[\s\x{a0}]+", " "))
    low = F.regexp_replace(F.regexp_replace(low, SCHEDULE, " "), LEADING_COUNT, " ")
    d = d.withColumn("_t", low)
    # the five pieces (number, times, unit, volume's number, volume) of the text's strength and of the column's unit
    text_pieces = F.split(F.regexp_replace(F.regexp_extract("_t", STRENGTH, 0), f"^{STRENGTH}$", "$1\t$2\t$3\t$4\t$5"), "\t", -1)
    column = F.lower(F.trim(F.col(f"`{unit}`")))
    column_pieces = F.split(F.regexp_replace(column, COLUMN_UNIT, "\t$1\t$2\t$3\t$4"), "\t", -1)
    d = d.withColumn("_p", text_pieces).withColumn("_c", column_pieces)
    stated = F.coalesce(F.size("_p") == 5, F.lit(False))
    readable = F.coalesce((column != "") & (F.size("_c") == 5) | column.rlike(rf"^(?:{_any(PIECES)})\.?$"), F.lit(False))
    counted = F.coalesce(F.col("_t").rlike(COUNTED), F.lit(False))
    nothing = F.array(F.lit(""), F.lit(""), F.coalesce(F.lower("_default"), F.lit("none")), F.lit(""), F.lit(""))
    d = d.withColumn("_how", F.when(stated, "text").when(readable, "column").otherwise("default")).withColumn("_counted", counted)
    d = d.withColumn("_b", F.when((F.col("_how") != "text") & ~F.col("_counted"), F.regexp_extract("_t", BARE, 1)))
    chosen = F.when(F.col("_how") == "text", F.col("_p")).when(F.col("_how") == "column", F.col("_c")).otherwise(nothing)
    written = F.when(F.col("_how") == "text", F.col("_p")[0]).otherwise(F.col("_b"))
    # regexp_extract gives "" where nothing is found and null for a null text
    number = F.when(F.coalesce(written, F.lit("")) != "", parse_number(written, F.col("_mark"))).when((F.col("_how") == "text") | ~F.col("_counted"), F.col(f"`{value}`"))
    d = d.withColumn("_x", chosen).withColumn("q_number", number)
    kind, factor = _unit_and_factor(*(F.coalesce(F.get("_x", F.lit(i)), F.lit("")) for i in range(1, 5)), F.when(F.col("_how") == "text", F.col("_mark")).otherwise("."))
    d = d.withColumn("q_bare", (F.col("_how") == "default") & ~F.col("_counted") & F.col("q_number").isNotNull()).withColumn("q_unit", kind)
    d = d.withColumn("q_factor", F.when(F.col("q_unit").isNotNull(), factor))
    return d.drop("_t", "_p", "_c", "_b", "_x", "_how", "_counted", "_default", "_mark")


def changepoints(total: np.ndarray, square: np.ndarray, count: np.ndarray, penalty: float) -> list[int]:
    """Where segments begin in the least-cost segmentation: squared distance to each segment's mean, plus a penalty per segment.

    Exact: every last change is tried for every end, except those that pruning
    proves can never be best again.
    """
    n = len(total)
    a, b, c = (np.concatenate([[0.0], np.cumsum(x)]) for x in (total, square, count))
    best, last = np.zeros(n + 1), np.zeros(n + 1, int)
    best[0] = -penalty
    alive = np.array([0])
    for end in range(1, n + 1):
        weight = np.maximum(c[end] - c[alive], 1e-12)
        cost = best[alive] + (b[end] - b[alive]) - (a[end] - a[alive]) ** 2 / weight
        i = int(np.argmin(cost))
        best[end], last[end] = cost[i] + penalty, alive[i]
        alive = np.append(alive[cost <= best[end]], end)
    cuts, at = [], n
    while at > 0:
        at = last[at]
        cuts.append(int(at))
    return cuts[::-1]


def _segment(penalty: float, tolerance: float):  # noqa: ANN202
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("day")
        total, square, count = (p[c].to_numpy(float) for c in ("total", "square", "n"))
        variance = max((square.sum() - total.sum() ** 2 / count.sum()) / count.sum(), 1e-6)
        begin = changepoints(total, square, count, penalty * variance * math.log(max(count.sum(), 2)))
        segment = np.searchsorted(begin, np.arange(len(p)), "right") - 1
        level = np.bincount(segment, total) / np.bincount(segment, count)
        home = level[int(np.argmax(np.bincount(segment, count)))]
        shift = np.ones(len(level))
        for i, x in enumerate(level - home):
            for f in KNOWN_FACTORS:
                if abs(x - math.log10(f)) <= tolerance:
                    shift[i] = f
        return pd.DataFrame({"source": p["source"], "day": p["day"], "segment": segment, "level": level[segment], "shift": shift[segment]})

    return run


def unit_shifts(history: DataFrame, penalty: float = 10.0, tolerance: float = 0.3) -> DataFrame:
    """Segments of each source's history: (source, day, segment, level, shift).

    ``history``: source string, day date, value double. Values are summed by day
    before they meet in a task, so a task holds one row per day of a source.
    ``shift`` is the known factor by which the segment differs from the source's
    longest one, 1 if by none. Null or non-positive values are left out.
    """
    log = F.log10("value")
    daily = history.filter("value > 0 and day is not null and source is not null").groupBy("source", "day").agg(F.sum(log).alias("total"), F.sum(log * log).alias("square"), F.count("*").alias("n"))
    return daily.groupBy("source").applyInPandas(_segment(penalty, tolerance), "source string, day date, segment long, level double, shift double")


def common_units(df: DataFrame, sources: DataFrame, text: str, value: str, unit: str, source: str, time: str) -> DataFrame:
    """Adds ``amount`` and ``common_unit`` (MG, MG/ML, UNT or ML); nulls where no such quantity is stated.

    The reading is used twice, for the histories and for the result, so it is
    written once to the shared folder: select the columns you need beforehand.
    """
    read = cut_lineage(read_quantities(df, sources, text, value, unit, source))
    bare = read.filter("q_bare and q_factor is not null").select(F.col(f"`{source}`").alias("source"), F.to_date(f"`{time}`").alias("day"), F.col("q_number").alias("value"))
    shifts = unit_shifts(bare).filter("shift != 1").select(F.col("source").alias("_s"), F.col("day").alias("_d"), "shift")
    joined = read.join(shifts, (F.col(f"`{source}`") == F.col("_s")) & (F.to_date(f"`{time}`") == F.col("_d")) & F.col("q_bare"), "left")
    amount = F.col("q_number") * F.col("q_factor") / F.coalesce("shift", F.lit(1.0))
    stated = F.col("q_number").isNotNull() & F.col("q_factor").isNotNull()
    return joined.withColumn("amount", F.when(stated, amount)).withColumn("common_unit", F.when(stated, F.col("q_unit"))).drop("_s", "_d", "shift", "q_number", "q_unit", "q_factor", "q_bare")
