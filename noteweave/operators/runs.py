"""Experiment runs compared and checked: registry, ranks, gates, splits, grids, identical outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.session import cut_lineage


def registry_issues(runs: DataFrame, rounds: int = 64) -> DataFrame:
    """(run_id, code): repeated ids, unknown parents, parents of another family, runs on or above a cycle of parents.

    ``runs``: run_id, family, parent_id. Ancestors are found by doubling: after n
    rounds every chain of 2 ** n runs has ended, or it turns in a circle.
    """
    repeated = runs.groupBy("run_id").agg(F.count("*").alias("n")).filter("n > 1").select("run_id", F.lit("duplicate_run_id").alias("code"))
    p = runs.select(F.col("run_id").alias("parent_id"), F.col("family").alias("pf")).dropDuplicates(["parent_id"])
    j = runs.filter("parent_id is not null").join(p, "parent_id", "left")
    wrong = j.select("run_id", F.when(F.col("pf").isNull(), "unknown_parent").when(F.col("pf") != F.col("family"), "parent_of_other_family").alias("code")).filter("code is not null")
    up = cut_lineage(runs.filter("parent_id is not null").select("run_id", F.col("parent_id").alias("up")).dropDuplicates(["run_id"]))
    n, reach = up.count(), 1
    for _ in range(rounds):
        if reach > n:
            break
        up = cut_lineage(up.join(up.select(F.col("run_id").alias("up"), F.col("up").alias("far")), "up").select("run_id", F.col("far").alias("up")))
        reach *= 2
    return repeated.unionByName(wrong).unionByName(up.select("run_id", F.lit("parent_cycle").alias("code")))


def decide_by_type(runs: DataFrame, types: DataFrame, useful: float, budget: float, density: float) -> DataFrame:
    """(run_id, decision, n_reasons): reject for too dense output or a type that lost more than ``budget`` against the parent; investigate a gain under ``useful``; else keep.

    ``runs``: run_id, parent_id, score, density. ``types``: run_id, entity_type, score.
    """
    parent = runs.select(F.col("run_id").alias("parent_id"), F.col("score").alias("ps"))
    d = runs.join(parent, "parent_id", "left")
    pt = types.select(F.col("run_id").alias("parent_id"), "entity_type", F.col("score").alias("pts"))
    lost = runs.select("run_id", "parent_id").join(pt, "parent_id").join(types.select("run_id", "entity_type", F.col("score").alias("ts")), ["run_id", "entity_type"], "left")
    lost = lost.filter(F.round(F.col("pts") - F.coalesce("ts", F.lit(0.0)), 9) > budget).groupBy("run_id").agg(F.count("*").alias("n_lost"))
    d = d.join(lost, "run_id", "left").fillna(0, ["n_lost"])
    dense = F.coalesce(F.col("density") > density, F.lit(True))
    small = F.col("ps").isNotNull() & (F.round(F.col("score") - F.col("ps"), 9) < useful)
    choice = F.when(dense | (F.col("n_lost") > 0), "reject").when(small, "investigate").otherwise("keep")
    return d.select("run_id", choice.alias("decision"), (dense.cast("int") + small.cast("int") + F.col("n_lost")).cast("int").alias("n_reasons"))


def ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank`` by descending keys, nulls last, then run_id."""
    return runs.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*(F.col(k).desc_nulls_last() for k in keys), "run_id")))  # one row a run


def gates(runs: DataFrame, by: str, passes: dict[str, str]) -> DataFrame:
    """Per ``by`` whether every run meets each condition."""
    return runs.groupBy(by).agg(*(F.bool_and(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in passes.items()), F.count("*").alias("n_runs"))


def shared_ids(splits: DataFrame) -> DataFrame:
    """(id, n_splits): ids that stand in more than one split."""
    return splits.filter("id is not null and split is not null").groupBy("id").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def coordinate_grid(axes: DataFrame, values: DataFrame) -> DataFrame:
    """(axis, value): every value of ``values`` in place of each axis's ``current`` one, one axis at a time. Two configuration lists."""
    return axes.join(values, F.col("value") != F.col("current")).select("axis", "value")


def compare_outputs(a: DataFrame, b: DataFrame, id: str, content: str) -> DataFrame:
    """(id, state): same or different by hash, or on one side only."""
    h = lambda d, n: d.select(F.col(id).alias("id"), F.sha2(F.coalesce(content, F.lit("")), 256).alias(n))
    j = h(a, "ha").join(h(b, "hb"), "id", "full")
    return j.select("id", F.when(F.col("ha").isNull(), "only_second").when(F.col("hb").isNull(), "only_first").when(F.col("ha") == F.col("hb"), "same").otherwise("different").alias("state"))
