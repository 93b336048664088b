"""Records and datasets checked: one row per broken rule.

Predictions come as JSON text, one array of records per document, and are read as
variants, so a value of a wrong kind is an issue and no parse failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.operators.cleanup import ASSERTABLE, ASSERTION_ORDER, LINKED

TYPES = ["THUỐC", "CHẨN_ĐOÁN", "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM"]
WARNINGS = ["duplicate_candidate", "duplicate_exact_span_type", "overlapping_entities"]
FIELDS = ["text", "position", "type", "assertions", "candidates"]


def file_issues(inputs: DataFrame, predictions: DataFrame, expected: int | None = None) -> DataFrame:
    """(id, code): documents without prediction, predictions without document, empty or unreadable JSON, a wrong number of documents (id null).

    ``inputs``: id, doc. ``predictions``: id, json.
    """
    a, b = inputs.select("id", "doc", F.lit(1).alias("_a")), predictions.select("id", "json", F.lit(1).alias("_b"))
    j = a.join(b, "id", "full")
    read = F.try_parse_json("json")
    code = (
        F.when(F.col("_b").isNull(), "prediction_file_missing").when(F.col("_a").isNull(), "extra_prediction_file").when(F.col("doc").isNull(), "raw_file_read_error").when(F.col("json").isNull(), "prediction_file_read_error")
        .when(F.trim("json") == "", "prediction_file_empty").when(read.isNull(), "json_parse_error")
    )
    out = j.select("id", code.alias("code")).filter("code is not null")
    if expected is None:
        return out
    n = inputs.agg(F.count("*").alias("n")).filter(F.col("n") != expected)
    return out.unionByName(n.select(F.lit(None).cast(inputs.schema["id"].dataType).alias("id"), F.lit("input_count_mismatch").alias("code")))


def parsed_records(predictions: DataFrame) -> DataFrame:
    """(id, idx, r): each record of each readable array, as a variant."""
    d = predictions.select("id", F.try_parse_json("json").alias("v")).filter("v is not null")
    items = F.try_variant_get("v", "$", "array<variant>")
    return d.select("id", F.posexplode(items).alias("idx", "r"))


def _kind(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(c), F.lit("VOID"))


def record_issues(inputs: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, idx, code): every rule that a record breaks, once per record and code; idx null for the array itself."""
    top = predictions.select("id", F.try_parse_json("json").alias("v")).filter("v is not null").filter(~F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")))
    listed = top.select("id", F.lit(None).cast("int").alias("idx"), F.lit("top_level_not_list").alias("code"))
    d = parsed_records(predictions).join(inputs.select("id", "doc"), "id")
    obj = F.startswith(_kind(F.col("r")), F.lit("OBJECT"))
    get = lambda f: F.try_variant_get("r", f"$.{f}", "variant")
    keys = F.json_object_keys(F.to_json("r"))
    d = d.withColumn("keys", F.when(obj, keys)).withColumns({f: get(f) for f in FIELDS})
    kinds = {f: _kind(F.col(f)) for f in FIELDS}
    is_string = lambda f: kinds[f] == "STRING"
    d = d.withColumn("t", F.when(is_string("text"), F.try_variant_get("text", "$", "string"))).withColumn("y", F.when(is_string("type"), F.try_variant_get("type", "$", "string")))
    items = lambda f: F.coalesce(F.when(F.startswith(kinds[f], F.lit("ARRAY")), F.try_variant_get(f, "$", "array<variant>")), F.array().cast("array<variant>"))
    d = d.withColumns({"p": items("position"), "a": items("assertions"), "c": items("candidates")})
    strings = lambda c: F.transform(F.filter(c, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    d = d.withColumns({"sa": strings(F.col("a")), "sc": strings(F.col("c"))})
    linked, has = F.coalesce(F.col("y").isin(LINKED), F.lit(False)), lambda f: F.array_contains("keys", f)
    pair = F.startswith(kinds["position"], F.lit("ARRAY")) & (F.size("p") == 2)
    whole = F.forall("p", lambda x: F.schema_of_variant(x) == "BIGINT")
    s, e = F.try_variant_get(F.get("p", F.lit(0)), "$", "bigint"), F.try_variant_get(F.get("p", F.lit(1)), "$", "bigint")
    bounds = (s >= 0) & (s < e) & (e <= F.length("doc"))
    repeated = lambda c: F.size(c) != F.size(F.array_distinct(c))
    allowed = F.array_union(F.array(*map(F.lit, FIELDS[:4])), F.when(linked, F.array(F.lit("candidates"))).otherwise(F.array().cast("array<string>")))
    is_list = lambda f: F.startswith(kinds[f], F.lit("ARRAY"))
    missing = F.exists(F.array(*map(F.lit, FIELDS[:4])), lambda f: ~F.array_contains("keys", f)) | (linked & ~has("candidates"))
    text = F.to_json("r")
    rules = [
        ("record_not_object", ~obj), ("missing_field", obj & missing), ("extra_field", obj & (F.size(F.array_except("keys", allowed)) > 0)),
        ("text_not_string", obj & ~is_string("text")), ("text_empty", F.col("t") == ""), ("type_not_string", obj & ~is_string("type")), ("invalid_type", F.col("y").isNotNull() & ~F.col("y").isin(TYPES)),
        ("position_not_pair", obj & ~pair), ("position_not_int", obj & pair & ~whole), ("position_out_of_bounds", obj & pair & whole & ~bounds),
        ("offset_mismatch", obj & pair & whole & bounds & F.col("t").isNotNull() & (F.substring("doc", (s + 1).cast("int"), (e - s).cast("int")) != F.col("t"))),
        ("assertions_missing", obj & (kinds["assertions"] == "VOID")), ("assertions_not_list", obj & (kinds["assertions"] != "VOID") & ~is_list("assertions")),
        ("assertion_not_string", F.size("a") != F.size("sa")), ("invalid_assertion", F.size(F.array_except("sa", F.array(*map(F.lit, ASSERTION_ORDER)))) > 0), ("duplicate_assertion", repeated(F.col("sa"))),
        ("non_assertable_type_has_assertion", (F.size("a") > 0) & ~F.coalesce(F.col("y").isin(ASSERTABLE), F.lit(False))),
        ("candidates_missing", obj & linked & ~has("candidates")), ("non_linked_type_has_candidates", obj & ~linked & has("candidates")), ("candidates_not_list", obj & has("candidates") & ~is_list("candidates")),
        ("candidate_not_string", F.size("c") != F.size("sc")), ("candidate_empty", F.array_contains("sc", "")), ("duplicate_candidate", repeated(F.col("sc"))),
        ("none_value", F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "").rlike("null")), ("nan_value", F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "").rlike("NaN")), ("infinite_value", F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "").rlike("Infinity")),
    ]
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules)))
    own = d.select("id", "idx", F.explode(codes).alias("code"))
    spans = d.filter(pair & whole & F.col("y").isNotNull()).select("id", "idx", s.alias("s"), e.alias("e"), "y")
    first = spans.withColumn("_n", F.row_number().over(W.partitionBy("id", "s", "e", "y").orderBy("idx"))).filter("_n > 1").select("id", "idx", F.lit("duplicate_exact_span_type").alias("code"))
    order = F.struct("a.s", "a.e", "a.y", "a.idx") < F.struct("b.s", "b.e", "b.y", "b.idx")
    over = spans.alias("a").join(spans.alias("b"), (F.col("a.id") == F.col("b.id")) & order & (F.col("b.s") < F.col("a.e")) & (F.col("a.s") < F.col("b.e")))
    over = over.select("b.id", "b.idx", F.lit("overlapping_entities").alias("code")).distinct()
    return listed.unionByName(own).unionByName(first).unionByName(over)


def issue_counts(issues: DataFrame) -> DataFrame:
    """How often each code occurs, and its level."""
    return issues.groupBy("code").agg(F.count("*").alias("n")).withColumn("level", F.when(F.col("code").isin(WARNINGS), "warning").otherwise("error"))


# --- datasets ----------------------------------------------------------------------------------------------------------

TIERS = ["GOLD", "SILVER", "SYNTHETIC_HIGH", "AUGMENTED_HIGH", "WEAK", "MANUAL"]
MARKER = r"\[\[/?E\d+\]\]"


def sample_issues(samples: DataFrame, tiers: list[str], key: Column) -> DataFrame:
    """(row, code): what is wrong with training samples, once per sample and code.

    ``samples``: row, file_id, text, entities, confidence_tier, source,
    generator_version, seed. ``key``: the normal form by which texts are equal.
    Repeated ids and texts are counted from the second row on.
    """
    t = F.col("text")
    later = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("row")) > 1
    d = samples.withColumn("_k", F.sha2(key, 256))
    d = d.withColumn("_id2", F.col("file_id").isNotNull() & later("file_id")).withColumn("_t2", t.isNotNull() & later("_k"))
    es = F.coalesce("entities", F.filter("entities", lambda e: F.lit(False)))
    bad = lambda f: F.exists("entities", f)
    pos = lambda e: (e["start_pos"] < 0) | (e["end_pos"] <= e["start_pos"]) | (e["end_pos"] > F.length("text")) | (F.substring(t, e["start_pos"] + 1, e["end_pos"] - e["start_pos"]) != e["text"])
    keys = F.transform("entities", lambda e: F.struct(e["start_pos"], e["end_pos"], e["entity_type"]))
    in_order = F.array_sort(F.transform("entities", lambda e: F.struct(e["start_pos"].alias("s"), e["end_pos"].alias("e"))))
    over = F.exists(F.transform(in_order, lambda x, i: F.exists(F.slice(in_order, F.lit(1), i), lambda y: (y["e"] > x["s"]) & (x["e"] > y["s"]))), lambda x: x)
    rules = [
        ("invalid_file_id", F.coalesce(F.col("file_id"), F.lit("")) == ""), ("duplicate_file_id", F.col("_id2")), ("invalid_text_or_entities", t.isNull() | F.col("entities").isNull()), ("empty_sample_text", F.trim(t) == ""),
        ("marker_leakage", t.rlike(MARKER)), ("duplicate_normalized_text", F.col("_t2")), ("invalid_confidence_tier", ~F.coalesce(F.col("confidence_tier").isin(tiers), F.lit(False))), ("invalid_source", F.coalesce(F.col("source"), F.lit("")) == ""),
        ("invalid_generator_version", F.coalesce(F.col("generator_version"), F.lit("")) == ""), ("invalid_seed", F.col("seed").isNull()),
        ("invalid_type", bad(lambda e: ~F.coalesce(e["entity_type"].isin(TYPES), F.lit(False)))), ("empty_entity_text", bad(lambda e: F.coalesce(F.trim(e["text"]), F.lit("")) == "")), ("offset_mismatch", bad(pos)),
        ("duplicate_exact_entity", F.size(keys) != F.size(F.array_distinct(keys))), ("invalid_entity_source", bad(lambda e: F.coalesce(e["source"], F.lit("")) == "")), ("overlapping_entities", over),
        ("missing_transformation_provenance", (F.col("confidence_tier") == "AUGMENTED_HIGH") & F.exists(es, lambda e: (F.coalesce(e["metadata"]["original_sample_id"], F.lit("")) == "") | (F.coalesce(F.size(e["metadata"]["transformations"]), F.lit(0)) <= 0))),
    ]
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules)))
    return d.select("row", F.explode(codes).alias("code"))
