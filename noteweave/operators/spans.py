"""Spans: overlap and containment joins, resolution, merging, greedy choices, matching and metrics.

Spans are (id, start_pos, end_pos, entity_type, ...), 0-based, end-exclusive.
Joins are equi-joins on the text's id with the interval test on top, so their
size is bounded by pairs within one text. Null positions match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import f1, safe_divide


def overlap_length(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(f"{a}.end_pos", f"{b}.end_pos") - F.greatest(f"{a}.start_pos", f"{b}.start_pos"))


def iou(a: str, b: str) -> Column:
    both = overlap_length(a, b)
    union = (F.col(f"{a}.end_pos") - F.col(f"{a}.start_pos")) + (F.col(f"{b}.end_pos") - F.col(f"{b}.start_pos")) - both
    return safe_divide(both, union)


def containment(a: str, b: str) -> Column:
    """Overlap over the shorter span."""
    shorter = F.least(F.col(f"{a}.end_pos") - F.col(f"{a}.start_pos"), F.col(f"{b}.end_pos") - F.col(f"{b}.start_pos"))
    return safe_divide(overlap_length(a, b), shorter)


def overlapping_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b as structs) of spans of one text that share a character."""
    on = (F.col("a.id") == F.col("b.id")) & (F.col("a.start_pos") < F.col("b.end_pos")) & (F.col("b.start_pos") < F.col("a.end_pos"))
    return left.alias("a").join(right.alias("b"), on)


def best_per_span(spans: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One row per exact span: the best by type priority, score and type name."""
    table = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    order = [F.coalesce(table[F.col("entity_type")], F.lit(99)), F.col("score").desc(), F.col("entity_type")]
    w = W.partitionBy("id", "start_pos", "end_pos").orderBy(*order)
    return spans.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def type_conflicts(spans: DataFrame) -> DataFrame:
    """Exact spans with more than one type: (id, start_pos, end_pos, types)."""
    g = spans.groupBy("id", "start_pos", "end_pos").agg(F.array_join(F.array_sort(F.collect_set("entity_type")), "|").alias("types"), F.count_distinct("entity_type").alias("n_types"))
    return g.filter("n_types > 1").select("id", "start_pos", "end_pos", "types")


def merge_duplicates(records: DataFrame) -> DataFrame:
    """One row per (id, start_pos, end_pos, entity_type) with the union of its attributes, sorted, and how many records it stands for."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    return records.groupBy("id", "start_pos", "end_pos", "entity_type").agg(flat("assertions").alias("assertions"), flat("candidates").alias("candidates"), F.count("*").alias("n_records"))


def exact_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Multiset one-to-one matches on (start, end, type): (id, start_pos, end_pos, entity_type, tp, fp, fn)."""
    keys = ["id", "start_pos", "end_pos", "entity_type"]
    p = pred.groupBy(keys).agg(F.count("*").alias("n_pred"))
    g = gold.groupBy(keys).agg(F.count("*").alias("n_gold"))
    both = p.join(g, keys, "full").fillna(0, ["n_pred", "n_gold"])
    tp = F.least("n_pred", "n_gold")
    return both.select(*keys, tp.alias("tp"), (F.col("n_pred") - tp).alias("fp"), (F.col("n_gold") - tp).alias("fn"))


def prf(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of summed counts; 0 where a divisor is 0."""
    s = counts.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumn("precision", F.round(safe_divide(tp, tp + fp), 6)).withColumn("recall", F.round(safe_divide(tp, tp + fn), 6)).withColumn("f1", F.round(f1(tp, fp, fn), 6))


def nearest_overlap(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """For each predicted span the gold span that it overlaps most (IoU, then first position); -1, "" and 0 without one."""
    p = pred.select("id", "start_pos", "end_pos", "entity_type").distinct()
    pairs = overlapping_pairs(p, gold).select(*(F.col(f"a.{c}").alias(c) for c in p.columns), F.col("b.start_pos").alias("gold_start"), F.col("b.end_pos").alias("gold_end"), F.col("b.entity_type").alias("gold_type"), F.round(iou("a", "b"), 6).alias("iou"))
    w = W.partitionBy("id", "start_pos", "end_pos", "entity_type").orderBy(F.col("iou").desc(), "gold_start", "gold_end", "gold_type")
    best = pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return p.join(best, p.columns, "left").fillna(-1, ["gold_start", "gold_end"]).fillna("", ["gold_type"]).fillna(0.0, ["iou"])


def boundary_kind(ps: Column, pe: Column, gs: Column, ge: Column) -> Column:
    """How a span's bounds differ from gold: exact, left, right or both."""
    return F.when((ps == gs) & (pe == ge), "exact").when(pe == ge, "left").when(ps == gs, "right").otherwise("both")


def structured_anchors(model: DataFrame, expert: DataFrame) -> DataFrame:
    """Model spans strictly inside or around an expert span of the same type, each with its best expert span."""
    strict = (F.col("a.start_pos") <= F.col("b.start_pos")) & (F.col("a.end_pos") >= F.col("b.end_pos")) | (F.col("b.start_pos") <= F.col("a.start_pos")) & (F.col("b.end_pos") >= F.col("a.end_pos"))
    differ = (F.col("a.start_pos") != F.col("b.start_pos")) | (F.col("a.end_pos") != F.col("b.end_pos"))
    pairs = overlapping_pairs(model, expert).filter(strict & differ & (F.col("a.entity_type") == F.col("b.entity_type")))
    named = pairs.select(*(F.col(f"a.{c}").alias(c) for c in ("id", "start_pos", "end_pos", "entity_type")), F.col("b.start_pos").alias("anchor_start"), F.col("b.end_pos").alias("anchor_end"), F.round(iou("a", "b"), 6).alias("iou"))
    w = W.partitionBy("id", "start_pos", "end_pos", "entity_type").orderBy(F.col("iou").desc(), "anchor_start", "anchor_end")
    return named.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _cluster(least: float):  # noqa: ANN202
    """Streams spans sorted by id, start, end and type. Only clusters that a later span can still join are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, live = object(), 0, []
        for b in batches:
            number = []
            for id, start, end in zip(*(b.column(c).to_pylist() for c in ("id", "start_pos", "end_pos")), strict=True):
                if id != at:
                    at, n, live = id, 0, []
                if start is not None and end is not None:
                    live = [g for g in live if g[1] > start]  # a member that ends here shares nothing with this span or a later one
                    joined = next((g for g in live if all(_fits(start, end, s, e, least) for s, e in g[2])), None)
                    if joined:
                        joined[1] = min(joined[1], end)
                        joined[2].append((start, end))
                        number.append(joined[0])
                        continue
                    live.append([n, end, [(start, end)]])
                number.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int32())], names=[*b.schema.names, "cluster_no"])

    return run


def _fits(start: int, end: int, s: int, e: int, least: float) -> bool:
    both = min(end, e) - max(start, s)
    return both > 0 and both / (end - start + e - s - both) >= least


def complete_link_clusters(spans: DataFrame, least: float = 0.5) -> DataFrame:
    """First-fit clusters in which every pair has IoU ``least`` or more."""
    d = spans.select("id", F.col("start_pos").cast("int"), F.col("end_pos").cast("int"), "entity_type").distinct()
    order = [F.asc_nulls_last(c) for c in ("start_pos", "end_pos", "entity_type")]
    shape = f"id {spans.schema['id'].dataType.simpleString()}, start_pos int, end_pos int, entity_type string, cluster_no int"
    return d.repartition("id").sortWithinPartitions("id", *order).mapInArrow(_cluster(least), shape)
