"""Proposals of several sources brought together: decoding, thresholds, evidence, agreement, clusters, survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.operators.evidence import lookup
from noteweave.operators.greedy import fold_kept, one_to_one
from noteweave.operators.spans import iou, overlapping_pairs
from noteweave.operators.views import trimmed

# Families, roles and anchors of sources; which sources speak for a type.
FAMILY = {"gliner": "semantic_backbone", "drug_rule": "structured_expert", "lab_rule": "structured_expert", "lab_result_rule": "structured_expert", "imaging_rule": "structured_expert", "problem_rule": "problem_expert", "dictionary": "dictionary"}
ROLE = {"gliner": "proposal", "drug_rule": "precision_anchor", "lab_rule": "structural_pair", "lab_result_rule": "structural_pair", "imaging_rule": "precision_anchor", "problem_rule": "type_evidence", "dictionary": "precision_anchor"}
ANCHOR = {"drug_rule": "drug_alias", "lab_rule": "lab_test", "lab_result_rule": "lab_result", "imaging_rule": "imaging_test", "problem_rule": "problem_head", "dictionary": "dictionary_alias"}
ANCHOR_TYPES = {"drug_rule": "THUỐC", "lab_rule": "TÊN_XÉT_NGHIỆM", "lab_result_rule": "KẾT_QUẢ_XÉT_NGHIỆM", "imaging_rule": "TÊN_XÉT_NGHIỆM"}
RULE_SCORE = "deterministic_rule_confidence"


def decode_tokens(tokens: DataFrame, threshold: float, thresholds: dict[str, float] | None = None, most: dict[str, int] | None = None) -> DataFrame:
    """(id, start_pos, end_pos, entity_type, score): spans of labelled tokens (id, start_pos, end_pos, label, score, doc).

    A span ends at B, O, another type or a gap of more than one character; an I
    may begin one. Spans under the threshold of their type, too long, of marks
    only, or over two line ends are left out. Scores are means.
    """
    w = W.partitionBy("id").orderBy("start_pos", "end_pos")
    kind = F.when(F.col("label").rlike("^[BI]-"), F.substring("label", 3, 100))
    d = tokens.withColumn("_y", kind)
    begins = F.col("_y").isNotNull() & (F.startswith("label", F.lit("B-")) | ~F.lag("_y").over(w).eqNullSafe(F.col("_y")) | (F.col("start_pos") > F.lag("end_pos").over(w) + 1))
    d = d.withColumn("_g", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_y is not null")
    g = d.groupBy("id", "_g").agg(F.min("start_pos").alias("s"), F.max("end_pos").alias("e"), F.first("_y").alias("entity_type"), F.avg("score").alias("score"), F.first("doc").alias("doc"))
    floor = F.coalesce(lookup(thresholds, F.col("entity_type")), F.lit(threshold)) if thresholds else F.lit(threshold)
    a, b = trimmed(F.col("doc"), F.col("s"), F.col("e"), r"\s")
    g = g.filter(F.round("score", 9) >= floor).withColumn("start_pos", a).withColumn("end_pos", b).filter("start_pos < end_pos")
    if most:
        g = g.filter(F.coalesce(F.col("end_pos") - F.col("start_pos") <= lookup(most, F.col("entity_type")), F.lit(True)))
    span = F.substring("doc", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    good = span.rlike(r"[^ \t\r\n\-–—,;:.()\[\]{}]") & (F.length(span) - F.length(F.replace(span, F.lit("\n"), F.lit(""))) < 2)
    return g.filter(good).select("id", "start_pos", "end_pos", "entity_type", "score")


def over_threshold(proposals: DataFrame, default: float, thresholds: dict[str, float]) -> DataFrame:
    """Proposals that reach their type's threshold."""
    return proposals.filter(F.col("score") >= F.coalesce(lookup(thresholds, F.col("entity_type")), F.lit(default)))


def inference_floor(default: float, thresholds: dict[str, float]) -> float:
    """The least of all thresholds: below it nothing can be kept, so a scan may leave it out."""
    return min([default, *thresholds.values()])


def merge_proposals(proposals: DataFrame) -> DataFrame:
    """One row per (id, start, end, type): the highest score, its pass and window, all passes and windows, how many agree."""
    best = F.max(F.struct("score", "pass_name", "window_id"))
    set_of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    g = proposals.groupBy("id", "start_pos", "end_pos", "entity_type").agg(best.alias("b"), set_of("pass_name").alias("passes"), set_of("window_id").alias("windows"), F.count("*").alias("agreement"))
    return g.select("id", "start_pos", "end_pos", "entity_type", "b.score", "b.pass_name", "b.window_id", "passes", "windows", "agreement")


def non_overlapping(spans: DataFrame) -> DataFrame:
    """The spans that stay when taken by start, longest, score, type and source, none overlapping one kept before."""
    order = [F.col("start_pos"), -F.col("end_pos"), -F.col("score"), F.col("entity_type"), F.col("source")]
    return fold_kept(spans, order, lambda kept, x: kept["end_pos"] > x["start_pos"])


def with_evidence(c: DataFrame) -> DataFrame:
    """Adds the evidence of a candidate (source, raw_type, score, pair_id, pattern): family, role, kind of score, anchor."""
    anchor = F.when((F.col("source") == "lab_result_rule") & (F.col("pattern") == "imaging_test_plus_result"), "imaging_result").otherwise(lookup(ANCHOR, F.col("source")))
    return c.withColumns({
        "ev_source": F.col("source"), "ev_type": F.col("raw_type"), "ev_score": F.col("score"), "ev_family": F.coalesce(lookup(FAMILY, F.col("source")), F.lit("other")), "ev_role": F.coalesce(lookup(ROLE, F.col("source")), F.lit("proposal")),
        "ev_score_kind": F.when(F.col("source") == "gliner", "gliner_probability").otherwise(RULE_SCORE), "ev_pair": F.col("pair_id"), "ev_anchor": anchor,
    })


def evidence_issues(c: DataFrame) -> DataFrame:
    """(row, code): where a candidate's evidence contradicts it."""
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules = [
        ("missing_evidence", F.col("ev_source").isNull()), ("evidence_source_mismatch", F.col("ev_source").isNotNull() & differ("ev_source", "source")), ("evidence_type_mismatch", differ("ev_type", "raw_type")),
        ("invalid_score_kind", F.col("ev_score_kind") != F.when(F.col("source") == "gliner", "gliner_probability").otherwise(RULE_SCORE)), ("evidence_score_mismatch", differ("ev_score", "score")),
        ("evidence_source_family_mismatch", F.col("ev_family") != F.coalesce(lookup(FAMILY, F.col("source")), F.lit("other"))), ("evidence_role_mismatch", F.col("ev_role") != F.coalesce(lookup(ROLE, F.col("source")), F.lit("proposal"))),
        ("structural_pair_mismatch", F.col("source").isin("lab_rule", "lab_result_rule") & F.col("pair_id").isNotNull() & differ("ev_pair", "pair_id")),
    ]
    codes = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), n) for n, x in rules)))
    return c.select("row", F.explode(codes).alias("code"))


def canonical(c: DataFrame) -> DataFrame:
    """One candidate per span, type and source: the highest score; numbered within its text (``no``)."""
    d = c.groupBy("id", "start_pos", "end_pos", "entity_type", "source").agg(F.max("score").alias("score"))
    return d.withColumn("no", (F.row_number().over(W.partitionBy("id").orderBy("start_pos", "end_pos", "source", "entity_type")) - 1).cast("int"))


def complementarity(model: DataFrame, experts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, category, model_no, expert_no): one-to-one matches, exact before near, agreement before conflict, then the unmatched of either side."""
    p = overlapping_pairs(model, experts)
    exact = (F.col("a.start_pos") == F.col("b.start_pos")) & (F.col("a.end_pos") == F.col("b.end_pos"))
    agree = F.col("a.entity_type") == F.col("b.entity_type")
    rank = F.when(exact & agree, 0).when(exact, 1).when(agree, 2).otherwise(3)
    d = p.filter(exact | (iou("a", "b") >= least)).select("a.id", F.col("a.no").alias("model_no"), F.col("b.no").alias("expert_no"), rank.alias("rank"), iou("a", "b").alias("iou"))
    m = one_to_one(d, [F.col("rank"), -F.col("iou")], "model_no", "expert_no")
    names = F.element_at(F.array(*map(F.lit, ("exact_agreement", "exact_type_conflict", "near_overlap_agreement", "near_overlap_type_conflict"))), F.col("rank") + 1)
    one = model.join(m.select("id", F.col("model_no").alias("no")), ["id", "no"], "left_anti").select("id", F.lit("model_only").alias("category"), F.col("no").alias("model_no"), F.lit(-1).alias("expert_no"))
    two = experts.join(m.select("id", F.col("expert_no").alias("no")), ["id", "no"], "left_anti").select("id", F.lit("expert_only").alias("category"), F.lit(-1).alias("model_no"), F.col("no").alias("expert_no"))
    return m.select("id", names.alias("category"), "model_no", "expert_no").unionByName(one).unionByName(two)


def unconfirmed(model: DataFrame, experts: DataFrame, final: DataFrame) -> DataFrame:
    """Model spans that no expert span overlaps, and whether each is among the final entities."""
    on = (F.col("m.id") == F.col("x.id")) & (F.col("m.start_pos") < F.col("x.end_pos")) & (F.col("x.start_pos") < F.col("m.end_pos"))
    alone = model.alias("m").join(experts.alias("x"), on, "left_anti")
    keys = ["id", "start_pos", "end_pos", "entity_type"]
    return alone.select(keys).distinct().join(final.select(*keys, F.lit(True).alias("survives")).distinct(), keys, "left").fillna(False, ["survives"])


def authority(entity_type: Column, source: Column, table: dict[str, list[str]]) -> Column:
    """How much a source counts for a type: the first of its list most, 0 outside it."""
    out = F.lit(0)
    for kind, sources in table.items():
        place = F.array_position(F.array(*map(F.lit, sources)), source)
        out = F.when((entity_type == kind) & (place > 0), len(sources) + 1 - place).otherwise(out)
    return out
