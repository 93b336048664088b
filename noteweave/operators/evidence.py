"""Type of a candidate span from the evidence for it, and the choice among candidates of one span.

Candidates are (id, start_pos, end_pos, raw_type, source, score) with ``doc``, the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import lookup_key
from noteweave.operators.cleanup import DISEASE_HEADS, SYMPTOM_HEADS, begins_with_any
from noteweave.operators.views import context

TYPES = ["THUỐC", "CHẨN_ĐOÁN", "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM"]
# Cues, priorities and confidences of evidence.
DRUG_CUES = ["thuốc", "uống", "dùng", "sử dụng", "điều trị", "liều", "tiêm", "truyền", "po", "iv", "bid", "tid", "qid", "prn", "mg", "mcg", "ml"]
NO_DISEASE = ["bệnh", "bệnh nhân", "người bệnh", "bệnh hiện tại", "tình trạng"]
SOURCE_PRIORITY = {"lab_result_rule": 100, "lab_rule": 95, "imaging_rule": 90, "drug_rule": 85, "problem_rule": 70, "dictionary": 60, "ner": 50}
TYPE_PRIORITY = {"KẾT_QUẢ_XÉT_NGHIỆM": 100, "TÊN_XÉT_NGHIỆM": 90, "THUỐC": 85, "CHẨN_ĐOÁN": 70, "TRIỆU_CHỨNG": 65}
CONFIDENCE = {"lab_result_rule": 0.95, "lab_rule": 0.92, "imaging_rule": 0.88, "drug_rule_with_context": 0.90, "drug_rule_without_context": 0.78, "problem_disease_head": 0.78, "problem_symptom_head": 0.78, "dictionary": 0.70, "ner_fallback": 0.65, "fallback": 0.50}
REASON_TYPE = {"lab_result_rule": "KẾT_QUẢ_XÉT_NGHIỆM", "lab_rule": "TÊN_XÉT_NGHIỆM", "imaging_rule": "TÊN_XÉT_NGHIỆM", "drug_rule_with_context": "THUỐC", "drug_rule_without_context": "THUỐC", "problem_disease_head": "CHẨN_ĐOÁN", "problem_symptom_head": "TRIỆU_CHỨNG"}


def lookup(values: dict, c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]


def best_scores(candidates: DataFrame) -> DataFrame:
    """One candidate per span, raw type and source, with the highest score."""
    return candidates.groupBy("id", "start_pos", "end_pos", "raw_type", "source").agg(F.max("score").alias("score"))


def flags(candidates: DataFrame) -> DataFrame:
    """Adds ``has_drug_context`` (a cue, even inside a word, within 80 characters), ``has_symptom_head`` and ``has_disease_head``."""
    s, e = F.col("start_pos"), F.col("end_pos")
    span = F.substring("doc", s + 1, e - s)
    left, right = context(F.col("doc"), s, e, 80)
    d = candidates.withColumn("_k", lookup_key(span)).withColumn("_c", lookup_key(F.concat(left, F.lit(" "), span, F.lit(" "), right)))
    disease = begins_with_any(F.col("_k"), DISEASE_HEADS) & ~F.col("_k").isin(NO_DISEASE) & ~F.col("_k").rlike("^(?:bệnh nhân|người bệnh) ")
    return d.withColumns({"has_drug_context": F.col("_c").rlike("|".join(DRUG_CUES)), "has_symptom_head": begins_with_any(F.col("_k"), SYMPTOM_HEADS), "has_disease_head": disease}).drop("_k", "_c")


def resolve(candidates: DataFrame) -> DataFrame:
    """Adds ``reason``, ``entity_type`` and ``confidence`` by the first rule that fits, null where none does, and ``warning``."""
    known = F.coalesce(F.col("raw_type").isin(TYPES), F.lit(False))
    source = F.col("source")
    reason = (
        F.when(source == "lab_result_rule", "lab_result_rule").when(source.isin("lab_rule", "imaging_rule"), source)
        .when((source == "drug_rule") & F.col("has_drug_context"), "drug_rule_with_context").when(source == "drug_rule", "drug_rule_without_context")
        .when((source == "dictionary") & known, "dictionary").when((source == "problem_rule") & F.col("has_disease_head"), "problem_disease_head")
        .when((source == "problem_rule") & F.col("has_symptom_head"), "problem_symptom_head").when(source.isin("ner", "gliner") & known, "ner_fallback").when(known, "fallback")
    )
    d = flags(candidates).withColumn("reason", reason)
    d = d.withColumn("entity_type", F.when(F.col("reason").isNotNull(), F.coalesce(lookup(REASON_TYPE, F.col("reason")), F.col("raw_type")))).withColumn("confidence", lookup(CONFIDENCE, F.col("reason")))
    bare = (F.col("entity_type") == "THUỐC") & ~F.col("has_drug_context")
    return d.withColumn("warning", F.when(bare, "drug_without_context").when(F.col("reason") == "fallback", "fallback_raw_type").otherwise(""))


def choose(resolved: DataFrame) -> DataFrame:
    """One entity per span: the best by type priority, confidence, score and source priority; with its sources and how many types they gave."""
    keys = ["id", "start_pos", "end_pos"]
    order = [F.coalesce(lookup(TYPE_PRIORITY, F.col("entity_type")), F.lit(0)).desc(), F.col("confidence").desc(), F.col("score").desc(), F.coalesce(lookup(SOURCE_PRIORITY, F.col("source")), F.lit(0)).desc(), F.col("source")]
    best = resolved.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1")
    every = resolved.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("source")), "|").alias("sources"), F.size(F.collect_set("entity_type")).alias("n_types"))
    return best.select(*keys, "entity_type", "confidence", F.col("source").alias("chosen_source"), "reason").join(every, keys)
