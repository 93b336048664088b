"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import canon, linking, mixing, neardup, overlap, packing, pii, sql, tokens, toxicity
from noteweave.session import cut_lineage

#: Notes are compared by three words, at one half: see TESTDATA.md, problem 1.
WORDS, LEAST = 3, 0.5
#: Recall of the candidate search at similarity 0.5 itself: 73 bands of 5 rows, 0.977 at 0.55.
RECALL = 0.9


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.similar_records(_table(spark, sf, "calibration"), "text", "file_id", WORDS, LEAST, RECALL)
    return pairs.select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = neardup.similar_groups(_table(spark, sf, "calibration"), "text", "sample_no", WORDS, LEAST, RECALL)
    return groups.withColumnRenamed("id", "sample_no")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    spans = pii.find_personal_data(_table(spark, sf, "calibration"), "text", "file_id")
    return spans.select(F.col("key").alias("file_id"), "pii_kind", "start_pos", "end_pos").distinct()


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact_personal_data(_table(spark, sf, "calibration").select("sample_no", "text"), "text").drop("text")


def _empty(c: str, of: DataFrame):  # noqa: ANN202
    array = of.schema[c].dataType.typeName() == "array"
    return F.coalesce(F.size(c), F.lit(0)) <= 0 if array else F.coalesce(F.trim(c), F.lit("")) == ""


def _typed_values(spark: SparkSession, sf: str) -> DataFrame:
    """(src_table, row_id, kind, text): every value without a code."""
    gold, drugs, diagnoses = (_table(spark, sf, t) for t in ("gold", "drug_aliases", "diagnosis_aliases"))
    kind = F.when(F.col("entity_type") == "THUỐC", "drug").when(F.col("entity_type") == "CHẨN_ĐOÁN", "diagnosis")
    parts = [
        gold.filter(F.col("entity_type").isin("THUỐC", "CHẨN_ĐOÁN") & _empty("candidates", gold)).select(F.lit("gold").alias("src_table"), F.col("record_id").alias("row_id"), kind.alias("kind"), "text"),
        drugs.filter(_empty("rxcui_hint", drugs)).select(F.lit("drug_aliases").alias("src_table"), F.col("alias_id").alias("row_id"), F.lit("drug").alias("kind"), F.col("alias").alias("text")),
        diagnoses.filter(_empty("code_hint", diagnoses)).select(F.lit("diagnosis_aliases").alias("src_table"), F.col("alias_id").alias("row_id"), F.lit("diagnosis").alias("kind"), F.col("canonical_hint").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _linked(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    drugs = linking.link(rows.filter("kind = 'drug'"), "text", "drug", _table(spark, sf, "rx_reference"))
    diagnoses = linking.link(rows.filter("kind = 'diagnosis'"), "text", "diagnosis", _table(spark, sf, "icd_reference"))
    return drugs.unionByName(diagnoses)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _typed_values(spark, sf)
    linked = cut_lineage(_linked(spark, sf, rows).select("src_table", "row_id", "code").filter("code is not null"))
    return linked.unionByName(linking.unmatched(rows, linked, ["src_table", "row_id"]).select("src_table", "row_id", F.lit("NONE").alias("code")))


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that mean no entry."""
    rows = _typed_values(spark, sf)
    return linking.unmatched(rows, _linked(spark, sf, rows), ["src_table", "row_id"]).select("src_table", "row_id", "text")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each table mean no entry."""
    found = p3_found(spark, sf)
    return found.groupBy("src_table").agg(F.count("*").alias("n_values"), F.count_if(F.col("code") == "NONE").alias("n_unmatched"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    notes = canon.find_variants(_table(spark, sf, "calibration"), "text", "file_id").distinct()
    aliases = canon.find_variants(_table(spark, sf, "symptoms_vi"), "alias", "alias_id").select(F.col("row_key").cast("string"))
    return notes.select(F.lit("calibration").alias("src_table"), "row_key").unionByName(aliases.select(F.lit("symptoms_vi").alias("src_table"), "row_key"))


def p5_canonical(spark: SparkSession, sf: str) -> DataFrame:
    notes = canon.unify_characters(_table(spark, sf, "calibration").select(F.col("sample_no").alias("row_no"), "text"), "text")
    aliases = canon.unify_characters(_table(spark, sf, "symptoms_vi").select(F.col("alias_id").alias("row_no"), F.col("alias").alias("text")), "text")
    both = notes.select(F.lit("calibration").alias("src_table"), "row_no", "canonical_text")
    return both.unionByName(aliases.select(F.lit("symptoms_vi").alias("src_table"), "row_no", "canonical_text"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.split_overlaps(_table(spark, sf, "calibration"), "text", "sample_no", "file_id", "split", "source", "train", WORDS, LEAST)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select(F.col("row_a").alias("sample_no_a"), F.col("row_b").alias("sample_no_b"), "eval_split", "eval_source")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, sf))


def _packed(spark: SparkSession, sf: str) -> list[tuple[str, int, DataFrame]]:
    sizes = cut_lineage(tokens.count_tokens(_table(spark, sf, "documents"), "text", ["doc_id"]))
    packs = _table(spark, sf, "pack_sizes").orderBy("capacity_tokens").collect()  # a fixed table of 3 rows
    return [(p["pack_name"], p["capacity_tokens"], packing.pack(sizes, "doc_id", p["capacity_tokens"])) for p in packs]


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, _, packed in _packed(spark, sf):
        one = packed.select(F.lit(name).alias("pack_name"), "container", "doc_id", "piece", "place", "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, capacity, packed in _packed(spark, sf):
        one = packing.packing_report(packed, capacity).withColumn("pack_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf, "documents").withColumn("weight", mixing.quality(F.col("text")))
    sizes = cut_lineage(tokens.count_tokens(docs, "text", ["doc_id", "source", "weight"]))
    targets = _table(spark, sf, "mix_targets")
    return mixing.mix(sizes, targets, "doc_id"), targets


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0].select("doc_id", "source", "n_tokens", "uses")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(*_mixed(spark, sf))


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    docs = _table(spark, sf, "documents").select("doc_id", "source", "text")
    found = toxicity.fit(docs, "text", "doc_id", _table(spark, sf, "toxic_labels"))
    return toxicity.score(docs, "text", ["doc_id", "source"], found.weights), found.threshold


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    scored, threshold = _scored(spark, sf)
    return scored.filter(F.col("score") >= threshold).select("doc_id")


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)[0].select("doc_id", F.round("score", 6).alias("score"))


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    scored, threshold = _scored(spark, sf)
    flag = F.col("score") >= threshold
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(flag).alias("n_flagged"), F.round(F.avg(flag.cast("int")), 6).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_redacted, p3_found, p3_unmatched, p3_counts, p5_found, p5_canonical, p6_found, p6_report, p7_packing, p7_report, p8_mix, p8_report, p9_found, p9_scores, p9_rates)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
