"""Matches between predicted and annotated spans, what is wrong with the rest, and scores per text and corpus.

Spans are (id, no, start_pos, end_pos, entity_type, ...); ``no`` numbers a side's
spans within their text and settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import jaccard, safe_divide
from noteweave.functions.wer import wer
from noteweave.operators.cleanup import ASSERTABLE, LINKED
from noteweave.operators.greedy import one_to_one
from noteweave.operators.spans import containment, iou, overlap_length, overlapping_pairs

TYPES = ["THUỐC", "CHẨN_ĐOÁN", "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM"]
WEIGHTS = {"text": 0.3, "assertions": 0.3, "candidates": 0.4}


def exact_pairs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, pred_no, gold_no): one-to-one matches on (start, end, type); the n-th of equal ones meets the n-th."""
    keys = ["id", "start_pos", "end_pos", "entity_type"]
    ranked = lambda d, n: d.select(*keys, F.col("no").alias(n), F.row_number().over(W.partitionBy(*keys).orderBy("no")).alias("_n"))
    return ranked(pred, "pred_no").join(ranked(gold, "gold_no"), [*keys, "_n"]).select("id", "pred_no", "gold_no")


def unmatched(spans: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return spans.join(pairs.select("id", F.col(side).alias("no")), ["id", "no"], "left_anti")


def _near(pred: DataFrame, gold: DataFrame, least_iou: float, least_containment: float) -> DataFrame:
    p = overlapping_pairs(pred, gold).withColumn("iou", iou("a", "b")).withColumn("share", containment("a", "b"))
    return p.filter((F.col("iou") >= least_iou) | (F.col("share") >= least_containment))


def relaxed_pairs(pred: DataFrame, gold: DataFrame, least_iou: float = 0.5, least_containment: float = 0.8) -> DataFrame:
    """(id, pred_no, gold_no, iou): greedy one-to-one matches of equal type: greatest IoU, then containment, then nearest lengths, then numbers."""
    p = _near(pred, gold, least_iou, least_containment).filter("a.entity_type = b.entity_type")
    gap = F.abs((F.col("a.end_pos") - F.col("a.start_pos")) - (F.col("b.end_pos") - F.col("b.start_pos")))
    d = p.select("a.id", F.col("a.no").alias("pred_no"), F.col("b.no").alias("gold_no"), "iou", "share", gap.alias("gap"))
    return one_to_one(d, [-F.col("iou"), -F.col("share"), F.col("gap")], "pred_no", "gold_no").select("id", "pred_no", "gold_no", "iou")


def mismatches(pred: DataFrame, gold: DataFrame, same_type: bool, least_iou: float = 0.5, least_containment: float = 0.8) -> DataFrame:
    """(id, pred_no, gold_no, category, subcategory): near pairs among what has no exact match, one-to-one: wrong bounds (equal types) or wrong type."""
    p = _near(pred, gold, least_iou, least_containment).filter(F.col("a.entity_type") == F.col("b.entity_type") if same_type else F.col("a.entity_type") != F.col("b.entity_type"))
    left, right = F.col("a.start_pos") == F.col("b.start_pos"), F.col("a.end_pos") == F.col("b.end_pos")
    kind = F.when(left & ~right, "right_boundary_error").when(~left & right, "left_boundary_error").otherwise("both_boundary_error") if same_type else F.concat("a.entity_type", F.lit("__vs__"), "b.entity_type")
    d = p.select("a.id", F.col("a.no").alias("pred_no"), F.col("b.no").alias("gold_no"), "iou", "share", kind.alias("subcategory"))
    best = one_to_one(d, [-F.col("iou"), -F.col("share")], "pred_no", "gold_no")
    return best.select("id", "pred_no", "gold_no", F.lit("span_mismatch" if same_type else "type_mismatch").alias("category"), "subcategory")


def nearest(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Each span with the number, IoU and containment of the other side's span that it overlaps most; -1 and 0 without one. Ties: the first."""
    p = overlapping_pairs(spans, others)
    best = F.max_by(F.struct(F.col("b.no").alias("near_no"), iou("a", "b").alias("iou"), containment("a", "b").alias("share")), F.struct(iou("a", "b"), containment("a", "b"), overlap_length("a", "b"), -F.col("b.no")))
    g = p.groupBy("a.id", "a.no").agg(best.alias("n")).select("id", "no", "n.*")
    d = spans.join(g, ["id", "no"], "left")
    return d.fillna(-1, ["near_no"]).fillna(0.0, ["iou", "share"])


def side_counts(pred: DataFrame, gold: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp and fn by ``by`` (id, entity_type): pairs count for the gold side."""
    hit = lambda d, n: d.join(pairs.select("id", F.col(n).alias("no"), F.lit(1).alias("hit")), ["id", "no"], "left")
    p = hit(pred, "pred_no").groupBy(*by).agg(F.count_if(F.col("hit").isNull()).alias("fp"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"))
    g = hit(gold, "gold_no").groupBy(*by).agg(F.lit(0).cast("long").alias("fp"), F.count_if(F.col("hit").isNotNull()).alias("tp"), F.count_if(F.col("hit").isNull()).alias("fn"))
    return p.unionByName(g).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def rates(counts: DataFrame, prefix: str = "") -> DataFrame:
    tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
    return counts.withColumn(prefix + "precision", F.round(safe_divide(tp, tp + fp), 6)).withColumn(prefix + "recall", F.round(safe_divide(tp, tp + fn), 6)).withColumn(prefix + "f1", F.round(safe_divide(2.0 * tp, 2 * tp + fp + fn), 6))


def set_agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Of pairs with arrays: how many, how many equal as sets, the rate."""
    empty = F.array().cast("array<string>")
    same = F.array_sort(F.array_distinct(F.coalesce(left, empty))) == F.array_sort(F.array_distinct(F.coalesce(right, empty)))
    return pairs.agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), F.round(safe_divide(F.count_if(same), F.count("*")), 6).alias("rate"))


def candidate_category(gold: Column, pred: Column) -> Column:
    """How predicted codes differ from annotated ones."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    common = F.size(F.array_intersect(g, p))
    return (
        F.when(F.array_sort(g) == F.array_sort(p), "exact_candidate_match").when(F.size(p) == 0, "missing_candidate")
        .when(F.size(g) == 0, "extra_candidate_when_gold_empty").when(common > 0, "partial_candidate").otherwise("wrong_candidate")
    )


def candidate_agreement(pairs: DataFrame, by: str, gold: str, pred: str) -> DataFrame:
    """By ``by``: pairs with annotated codes, those hit, those exactly equal, rates, and pairs skipped for having none."""
    empty = F.array().cast("array<string>")
    d = pairs.select(by, F.coalesce(gold, empty).alias("g"), F.coalesce(pred, empty).alias("p"))
    have, hit = F.size("g") > 0, F.arrays_overlap("g", "p")
    equal = candidate_category(F.col("g"), F.col("p")) == "exact_candidate_match"
    a = d.groupBy(by).agg(F.count_if(have).alias("total_evaluable"), F.count_if(have & hit).alias("hit_count"), F.count_if(have & equal).alias("exact_set_match_count"), F.count_if(~have).alias("skipped_empty_gold"))
    return a.withColumn("hit_rate", F.round(safe_divide(F.col("hit_count"), F.col("total_evaluable")), 6)).withColumn("exact_set_match_rate", F.round(safe_divide(F.col("exact_set_match_count"), F.col("total_evaluable")), 6))


# --- scores ------------------------------------------------------------------------------------------------------------


def concept_pairs(pred: DataFrame, gold: DataFrame, same_type: bool = True) -> DataFrame:
    """(id, pred_no, gold_no): greedy one-to-one matches by most common characters."""
    p = overlapping_pairs(pred, gold)
    p = p.filter("a.entity_type = b.entity_type") if same_type else p
    d = p.select("a.id", F.col("a.no").alias("pred_no"), F.col("b.no").alias("gold_no"), overlap_length("a", "b").alias("both"))
    return one_to_one(d, [-F.col("both")], "pred_no", "gold_no").select("id", "pred_no", "gold_no")


def _attributes(spans: DataFrame, name: str, field: str, types: list[str]) -> DataFrame:
    each = spans.filter(F.col("entity_type").isin(types)).select("id", "concept", F.explode(field).alias("v"))
    return each.groupBy("id").agg(F.collect_set(F.concat_ws("\u0001", "concept", "v")).alias(name))


def text_scores(pred: DataFrame, gold: DataFrame, ids: DataFrame) -> DataFrame:
    """Per text: words wrong, the share of texts' words right over spans by position, attributes in common, and the weight of its codes.

    (id, text, assertions, candidates, candidate_weight, n_pred, n_gold). Both
    sides: id, no, start_pos, end_pos, entity_type, text, assertions, candidates.
    A text without predictions counts as one with none.
    """
    m = concept_pairs(pred, gold)
    p = pred.join(m.withColumnRenamed("pred_no", "no"), ["id", "no"], "left").withColumn("concept", F.coalesce(F.concat(F.lit("g"), "gold_no"), F.concat(F.lit("p"), "no")))
    g = gold.withColumn("concept", F.concat(F.lit("g"), "no"))
    words = lambda d, n: d.groupBy("id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "no", "text"))), lambda x: x["text"]), " ")).alias(n), F.count("*").alias("n_" + n))
    weight = gold.filter(F.col("entity_type").isin(LINKED)).groupBy("id").agg(F.sum(F.size("candidates") + 1).alias("candidate_weight"))
    d = ids.select("id").join(words(pred, "pred"), "id", "left").join(words(gold, "gold"), "id", "left").join(weight, "id", "left")
    for side, s in (("p", p), ("g", g)):
        d = d.join(_attributes(s, side + "_a", "assertions", ASSERTABLE), "id", "left").join(_attributes(s, side + "_c", "candidates", LINKED), "id", "left")
    right = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - wer(F.col("gold"), F.col("pred"))))
    return d.select(
        "id", F.round(right, 6).alias("text"), F.round(jaccard(F.col("p_a"), F.col("g_a")), 6).alias("assertions"), F.round(jaccard(F.col("p_c"), F.col("g_c")), 6).alias("candidates"),
        F.coalesce("candidate_weight", F.lit(0)).cast("long").alias("candidate_weight"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
    )


def corpus_score(scores: DataFrame) -> DataFrame:
    """Means over texts (candidates by weight, 1 if nothing has any) and their weighted sum."""
    n = F.sum("candidate_weight")
    a = scores.agg(F.avg("text").alias("text_score"), F.avg("assertions").alias("assertions_score"), F.when(n > 0, F.sum(F.col("candidates") * F.col("candidate_weight")) / n).otherwise(1.0).alias("candidates_score"))
    final = WEIGHTS["text"] * F.col("text_score") + WEIGHTS["assertions"] * F.col("assertions_score") + WEIGHTS["candidates"] * F.col("candidates_score")
    return a.withColumn("final_score", final).select(*(F.round(c, 6).alias(c) for c in ("text_score", "assertions_score", "candidates_score", "final_score")))


def span_oracle(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with the bounds of the annotated span they match."""
    m = concept_pairs(pred, gold).withColumnRenamed("pred_no", "no")
    b = gold.select("id", F.col("no").alias("gold_no"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"))
    d = pred.join(m, ["id", "no"], "left").join(b, ["id", "gold_no"], "left")
    return d.withColumn("start_pos", F.coalesce("_s", "start_pos")).withColumn("end_pos", F.coalesce("_e", "end_pos")).drop("_s", "_e", "gold_no")


def type_oracle(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with the type of the annotated span they overlap most, whatever their own."""
    m = concept_pairs(pred, gold, same_type=False).withColumnRenamed("pred_no", "no")
    b = gold.select("id", F.col("no").alias("gold_no"), F.col("entity_type").alias("_t"))
    return pred.join(m, ["id", "no"], "left").join(b, ["id", "gold_no"], "left").withColumn("entity_type", F.coalesce("_t", "entity_type")).drop("_t", "gold_no")
