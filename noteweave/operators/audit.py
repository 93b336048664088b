"""Validation, agreement, leakage, coverage, distributions, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import fold, lookup_key

ASSERTIONS = ["isNegated", "isFamily", "isHistorical"]


def coverage(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Keys on one side only or on both, with their row counts: a full outer join of counts."""
    a = inputs.filter(f"{key} is not null").groupBy(key).agg(F.count("*").alias("n_inputs"))
    b = outputs.filter(f"{key} is not null").groupBy(key).agg(F.count("*").alias("n_outputs"))
    both = a.join(b, key, "full").fillna(0, ["n_inputs", "n_outputs"])
    return both.withColumn("state", F.when(F.col("n_outputs") == 0, "missing").when(F.col("n_inputs") == 0, "extra").otherwise("both"))


def attribute_agreement(pairs: DataFrame, left: str, right: str, labels: list[str]) -> DataFrame:
    """Per label: tp, fp, fn of the right array against the left one; null arrays are empty."""
    empty = F.array().cast("array<string>")
    d = pairs.select(F.coalesce(left, empty).alias("l"), F.coalesce(right, empty).alias("r"))
    d = d.select("l", "r", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    x, y = F.array_contains("l", F.col("label")), F.array_contains("r", F.col("label"))
    return d.groupBy("label").agg(F.count_if(x & y).alias("tp"), F.count_if(~x & y).alias("fp"), F.count_if(x & ~y).alias("fn"))


def exact_leakage(df: DataFrame, text: str, id: str, split: str, train: str = "train") -> DataFrame:
    """Rows outside training whose normal text also occurs in training, by hash of the whole text: (id, split)."""
    key = F.sha2(lookup_key(F.col(f"`{text}`")), 256)
    d = df.select(F.col(id).alias("id"), F.col(split).alias("split"), key.alias("k")).filter("k is not null")
    seen = d.filter(F.col("split") == train).select("k").distinct()
    return d.filter(F.col("split") != train).join(seen, "k", "left_semi").select("id", "split")


def group_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split: (group, splits, n_rows)."""
    d = df.filter(f"{group} is not null and {split} is not null").groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits"), F.count_distinct(split).alias("n"), F.count("*").alias("n_rows"))
    return d.filter("n > 1").select(F.col(group).alias("group_key"), "splits", "n_rows")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, total, mean, median and 95th percentile (linear interpolation) of a value; nulls are left out."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(v).cast("long").alias("total"), F.round(F.avg(v), 6).alias("mean"),
        F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.95), 6).alias("p95"),
    )


def outliers(df: DataFrame, id: str, by: str, value: str) -> DataFrame:
    """Rows above their group's 95th percentile: (id, group, value)."""
    limit = df.filter(f"{value} is not null").groupBy(by).agg(F.percentile(F.col(value), 0.95).alias("p95"))
    return df.join(limit, by).filter(F.col(value) > F.col("p95")).select(F.col(id).alias("id"), F.col(by).alias("group_key"), F.col(value).alias("value"))


def run_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or same for each key of two runs."""
    a = before.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia"))
    b = after.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    state = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def bio_labels(tok: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``label``: B-type for a span's first token, I-type for the rest, O outside; the first span wins."""
    inside = (F.col("t.id") == F.col("s.id")) & (F.col("t.start_pos") >= F.col("s.start_pos")) & (F.col("t.end_pos") <= F.col("s.end_pos"))
    j = tok.alias("t").join(spans.alias("s"), inside, "left").select("t.*", F.col("s.start_pos").alias("_s"), F.col("s.entity_type").alias("_y"))
    best = j.groupBy(*tok.columns).agg(F.min(F.struct("_s", "_y")).alias("m"))
    mark = F.when(F.col("m._s").isNull(), "O").when(F.col("m._s") == F.col("start_pos"), F.concat(F.lit("B-"), F.col("m._y"))).otherwise(F.concat(F.lit("I-"), F.col("m._y")))
    return best.withColumn("label", mark).drop("m")


def bio_spans(labelled: DataFrame) -> DataFrame:
    """(id, start_pos, end_pos, entity_type, n_tokens): islands of B and I labels; an I of another type begins one too."""
    w = W.partitionBy("id").orderBy("pos")
    kind = F.substring("label", 3, 100)
    before = F.lag("label", 1, "O").over(w)
    begins = (F.col("label") != "O") & (F.col("label").startswith("B-") | (before == "O") | (F.substring(before, 3, 100) != kind))
    island = F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = labelled.withColumn("_k", kind).withColumn("_i", island).filter("label != 'O'")
    return d.groupBy("id", "_i").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("_k").alias("entity_type"), F.count("*").alias("n_tokens")).drop("_i")


def noisy(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, kind, noisy_text): the text in four noisy spellings."""
    t = F.col("t")
    forms = F.array(
        F.struct(F.lit("accentless").alias("kind"), fold(t).alias("noisy_text")),
        F.struct(F.lit("lower").alias("kind"), F.lower(t).alias("noisy_text")),
        F.struct(F.lit("spaced").alias("kind"), F.regexp_replace(t, " ", "  ").alias("noisy_text")),
        F.struct(F.lit("repeat_first").alias("kind"), F.regexp_replace(t, r"^([^ ]+) ", "$1 $1 ").alias("noisy_text")),
    )
    return df.select(F.col(id).alias("id"), F.col(f"`{text}`").alias("t")).filter("t is not null").select("id", F.explode(forms).alias("f")).select("id", "f.kind", "f.noisy_text")
