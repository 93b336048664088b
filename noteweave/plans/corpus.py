"""Queries on records, proposals, datasets and runs: validation, fusion, construction, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import docs, fusion, validation
from noteweave.plans import catalog, entities
from noteweave.plans.base import KEY, query, table
from noteweave.plans.catalog import CHUNKS, GOLD, TOKENS
from noteweave.plans.evaluation import _IOU, _over, greedy_sql
from noteweave.plans.lexical import BARE, COMPOSED

# --- records as JSON ---------------------------------------------------------------------------------------------------

# Each annotation becomes a record, some of them broken by their number, so every rule has something to find.
_Q = lambda c: f"'\"' || replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
_JSON = (
    f"{GOLD}, rec AS (SELECT id, start_pos, end_pos, entity_type, text, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type, text) - 1 AS INTEGER) AS idx, (id * 31 + row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type, text)) % 41 AS m FROM gold_spans WHERE NOT regexp_matches(text, '[\\x00-\\x1f]')), "
    f"js AS (SELECT id, idx, m, CASE WHEN m = 1 THEN '7' WHEN m = 2 THEN '{{\"text\":' || {_Q('text')} || '}}' ELSE '{{\"text\":' || CASE WHEN m = 3 THEN '5' WHEN m = 4 THEN '\"\"' ELSE {_Q('text')} END || ',\"position\":' || CASE m WHEN 5 THEN '[' || start_pos || ']' WHEN 6 THEN '[' || start_pos || ',\"9\"]' WHEN 7 THEN '[' || start_pos || ',' || (end_pos + 1000000) || ']' WHEN 8 THEN '[' || (start_pos + 1) || ',' || (end_pos + 1) || ']' ELSE '[' || start_pos || ',' || end_pos || ']' END "
    "|| ',\"type\":' || CASE m WHEN 9 THEN '3' WHEN 10 THEN '\"X\"' ELSE '\"' || entity_type || '\"' END || ',\"assertions\":' || CASE m WHEN 11 THEN 'null' WHEN 12 THEN '\"isNegated\"' WHEN 13 THEN '[4]' WHEN 14 THEN '[\"other\"]' WHEN 15 THEN '[\"isFamily\",\"isFamily\"]' WHEN 16 THEN '[\"isNegated\"]' ELSE '[]' END "
    "|| CASE WHEN m = 17 THEN ',\"more\":1' ELSE '' END || CASE WHEN m = 18 THEN ',\"candidates\":\"a\"' WHEN m = 19 THEN ',\"candidates\":[1,\"b\"]' WHEN m = 20 THEN ',\"candidates\":[\"\",\"b\",\"b\"]' WHEN m = 21 THEN '' WHEN m = 22 OR entity_type IN ('THUỐC', 'CHẨN_ĐOÁN') THEN ',\"candidates\":[\"c\"]' ELSE '' END || '}' END AS r, start_pos, end_pos, text, entity_type FROM rec)"
)
_SHOWN = (
    ", docu AS (SELECT sample_no AS id, text AS doc FROM calibration WHERE text IS NOT NULL), f AS (SELECT j.*, doc, m = 1 AS nobj, m = 2 AS bare, CASE WHEN m IN (1, 2, 9) THEN NULL WHEN m = 10 THEN 'X' ELSE entity_type END AS y, CASE WHEN m IN (1, 3) THEN NULL WHEN m = 4 THEN '' ELSE text END AS t, m NOT IN (1, 2, 5) AS pair, "
    "m NOT IN (1, 2, 5, 6) AS ints, CASE m WHEN 8 THEN start_pos + 1 ELSE start_pos END AS s, CASE m WHEN 7 THEN end_pos + 1000000 WHEN 8 THEN end_pos + 1 ELSE end_pos END AS e FROM js j JOIN docu USING (id)), "
    "g AS (SELECT *, coalesce(y IN ('THUỐC', 'CHẨN_ĐOÁN'), false) AS linked, NOT nobj AND NOT bare AND (m IN (18, 19, 20, 22) OR (m <> 21 AND entity_type IN ('THUỐC', 'CHẨN_ĐOÁN'))) AS hasc FROM f), "
    "iss AS (SELECT id, idx, unnest(list_filter([CASE WHEN nobj THEN 'record_not_object' END, CASE WHEN bare OR (linked AND NOT hasc) THEN 'missing_field' END, CASE WHEN m = 17 OR (hasc AND NOT linked) THEN 'extra_field' END, CASE WHEN m = 3 THEN 'text_not_string' END, CASE WHEN t = '' THEN 'text_empty' END, CASE WHEN m IN (2, 9) THEN 'type_not_string' END, CASE WHEN m = 10 THEN 'invalid_type' END, "
    "CASE WHEN NOT nobj AND NOT pair THEN 'position_not_pair' END, CASE WHEN m = 6 THEN 'position_not_int' END, CASE WHEN ints AND NOT (s >= 0 AND s < e AND e <= length(doc)) THEN 'position_out_of_bounds' END, CASE WHEN ints AND s >= 0 AND s < e AND e <= length(doc) AND t IS NOT NULL AND substring(doc, s + 1, e - s) <> t THEN 'offset_mismatch' END, "
    "CASE WHEN m IN (2, 11) THEN 'assertions_missing' END, CASE WHEN m = 12 THEN 'assertions_not_list' END, CASE WHEN m = 13 THEN 'assertion_not_string' END, CASE WHEN m = 14 THEN 'invalid_assertion' END, CASE WHEN m = 15 THEN 'duplicate_assertion' END, CASE WHEN m IN (13, 14, 15, 16) AND NOT coalesce(y IN ('THUỐC', 'CHẨN_ĐOÁN', 'TRIỆU_CHỨNG'), false) THEN 'non_assertable_type_has_assertion' END, "
    "CASE WHEN linked AND NOT hasc THEN 'candidates_missing' END, CASE WHEN NOT linked AND hasc THEN 'non_linked_type_has_candidates' END, CASE WHEN m = 18 THEN 'candidates_not_list' END, CASE WHEN m = 19 THEN 'candidate_not_string' END, CASE WHEN m = 20 THEN 'candidate_empty' END, CASE WHEN m = 20 THEN 'duplicate_candidate' END, CASE WHEN m = 11 THEN 'none_value' END], lambda c: c IS NOT NULL)) AS code FROM g), "
    "sp AS (SELECT id, idx, s, e, y FROM g WHERE ints AND y IS NOT NULL), every AS (SELECT * FROM iss UNION ALL SELECT id, idx, 'duplicate_exact_span_type' FROM (SELECT *, row_number() OVER (PARTITION BY id, s, e, y ORDER BY idx) AS n FROM sp) WHERE n > 1 UNION ALL SELECT DISTINCT b.id, b.idx, 'overlapping_entities' FROM sp a JOIN sp b ON a.id = b.id AND (a.s, a.e, a.y, a.idx) < (b.s, b.e, b.y, b.idx) AND b.s < a.e AND a.s < b.e)"
)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, json): an array of records per note, made of its annotations; some broken by their number."""
    g = catalog._gold(spark, sf).filter(~F.col("text").rlike(r"[\x00-\x1f]"))
    n = F.row_number().over(W.partitionBy("id").orderBy("start_pos", "end_pos", "entity_type", "text"))
    d = g.withColumn("n", n).withColumn("m", (F.col("id") * 31 + F.col("n")) % 41)
    s, e, m = F.col("start_pos").cast("string"), F.col("end_pos"), F.col("m")
    at = lambda *x: F.concat(F.lit("["), *x, F.lit("]"))
    num = lambda c: c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    position = F.when(m == 5, at(s)).when(m == 6, at(s, F.lit(',"9"'))).when(m == 7, at(s, F.lit(","), num(e + 1000000))).when(m == 8, at(num(F.col("start_pos") + 1), F.lit(","), num(e + 1))).otherwise(at(s, F.lit(","), num(e)))
    said = F.when(m == 11, "null").when(m == 12, '"isNegated"').when(m == 13, "[4]").when(m == 14, '["other"]').when(m == 15, '["isFamily","isFamily"]').when(m == 16, '["isNegated"]').otherwise("[]")
    kind = F.when(m == 9, "3").when(m == 10, '"X"').otherwise(F.concat(F.lit('"'), "entity_type", F.lit('"')))
    codes = F.when(m == 18, ',"candidates":"a"').when(m == 19, ',"candidates":[1,"b"]').when(m == 20, ',"candidates":["","b","b"]').when(m == 21, "").when((m == 22) | F.col("entity_type").isin("THUỐC", "CHẨN_ĐOÁN"), ',"candidates":["c"]').otherwise("")
    whole = F.concat(F.lit('{"text":'), F.when(m == 3, "5").when(m == 4, '""').otherwise(quoted), F.lit(',"position":'), position, F.lit(',"type":'), kind, F.lit(',"assertions":'), said, F.when(m == 17, ',"more":1').otherwise(""), codes, F.lit("}"))
    r = F.when(m == 1, "7").when(m == 2, F.concat(F.lit('{"text":'), quoted, F.lit("}"))).otherwise(whole)
    g = d.select("id", "n", r.alias("r")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("rs"))
    return g.select("id", F.concat(F.lit("["), F.array_join("rs.r", ","), F.lit("]")).alias("json"))


@query(f"WITH {_JSON}{_SHOWN} SELECT id, idx, code FROM every")
def record_validation(spark: SparkSession, sf: str) -> DataFrame:
    return validation.record_issues(entities._docs(spark, sf), _predictions(spark, sf))


@query(f"WITH {_JSON}{_SHOWN} SELECT code, count(*) AS n, CASE WHEN code IN ('duplicate_candidate', 'duplicate_exact_span_type', 'overlapping_entities') THEN 'warning' ELSE 'error' END AS level FROM every GROUP BY 1")
def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.issue_counts(validation.record_issues(entities._docs(spark, sf), _predictions(spark, sf)))


@query("WITH i AS (SELECT sample_no AS id, text AS doc FROM calibration WHERE sample_no % 7 <> 0), p AS (SELECT sample_no AS id, CASE sample_no % 5 WHEN 0 THEN '' WHEN 1 THEN '[{' WHEN 2 THEN NULL ELSE '[]' END AS json FROM calibration WHERE sample_no % 3 <> 0) SELECT id, code FROM (SELECT coalesce(i.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'prediction_file_missing' WHEN i.id IS NULL THEN 'extra_prediction_file' WHEN i.doc IS NULL THEN 'raw_file_read_error' WHEN json IS NULL THEN 'prediction_file_read_error' WHEN trim(json) = '' THEN 'prediction_file_empty' WHEN json = '[{' THEN 'json_parse_error' END AS code FROM i FULL JOIN p USING (id)) WHERE code IS NOT NULL UNION ALL SELECT NULL, 'input_count_mismatch' FROM i HAVING count(*) <> 3")
def file_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Every note is an input or a prediction file or both, by its number, so each way of missing or breaking occurs."""
    c = table(spark, sf, "calibration")
    m = F.col("sample_no") % 5
    inputs = c.filter("sample_no % 7 != 0").select(F.col("sample_no").alias("id"), F.col("text").alias("doc"))
    pred = c.filter("sample_no % 3 != 0").select(F.col("sample_no").alias("id"), F.when(m == 0, "").when(m == 1, "[{").when(m == 2, None).otherwise("[]").alias("json"))
    return validation.file_issues(inputs, pred, 3)


_TIERS = ["GOLD", "SILVER", "SYNTHETIC_HIGH", "AUGMENTED_HIGH"]
_K = f"sha256({COMPOSED.format('text')})"
_BAD = lambda c: f"len(list_filter(entities, lambda e: {c})) > 0"
_CODES = [
    ("invalid_file_id", "coalesce(file_id, '') = ''"), ("duplicate_file_id", "file_id IS NOT NULL AND n1 > 1"), ("invalid_text_or_entities", "text IS NULL OR entities IS NULL"), ("empty_sample_text", "trim(text) = ''"), ("marker_leakage", "regexp_matches(text, '\\[\\[/?E\\d+\\]\\]')"),
    ("duplicate_normalized_text", "text IS NOT NULL AND n2 > 1"), ("invalid_confidence_tier", "NOT coalesce(confidence_tier IN ('" + "', '".join(_TIERS) + "'), false)"), ("invalid_source", "coalesce(source, '') = ''"), ("invalid_generator_version", "coalesce(generator_version, '') = ''"), ("invalid_seed", "seed IS NULL"),
    ("invalid_type", _BAD("NOT coalesce(e.entity_type IN ('THUỐC', 'CHẨN_ĐOÁN', 'TRIỆU_CHỨNG', 'TÊN_XÉT_NGHIỆM', 'KẾT_QUẢ_XÉT_NGHIỆM'), false)")), ("empty_entity_text", _BAD("coalesce(trim(e.text), '') = ''")), ("offset_mismatch", _BAD("e.start_pos < 0 OR e.end_pos <= e.start_pos OR e.end_pos > length(text) OR substring(text, e.start_pos + 1, e.end_pos - e.start_pos) <> e.text")),
    ("duplicate_exact_entity", "len(entities) <> len(list_distinct(list_transform(entities, lambda e: {'a': e.start_pos, 'b': e.end_pos, 'c': e.entity_type})))"), ("invalid_entity_source", _BAD("coalesce(e.source, '') = ''")), ("overlapping_entities", "len(list_filter(entities, lambda e, i: len(list_filter(entities, lambda o, j: i <> j AND o.start_pos < e.end_pos AND e.start_pos < o.end_pos)) > 0)) > 0"),
    ("missing_transformation_provenance", "confidence_tier = 'AUGMENTED_HIGH' AND " + _BAD("coalesce(e.metadata.original_sample_id, '') = '' OR len(coalesce(e.metadata.transformations, [])) = 0")),
]


@query(f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sample_no) AS n1, row_number() OVER (PARTITION BY {_K} ORDER BY sample_no) AS n2 FROM calibration) SELECT sample_no AS row, unnest(list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in _CODES) + "], lambda c: c IS NOT NULL)) AS code FROM d")
def dataset_validation(spark: SparkSession, sf: str) -> DataFrame:
    return validation.sample_issues(table(spark, sf, "calibration").withColumn("row", F.col("sample_no")), _TIERS, tx.composed_key(F.col("text")))


# --- sections ----------------------------------------------------------------------------------------------------------

_PATTERNS = [(label, i, p) for i, (label, p) in enumerate([
    ("PAST_HISTORY", "tiền sử"), ("PAST_MEDICAL_HISTORY", "tiền sử bệnh"), ("PRE_ADMISSION_MEDICATION", "thuốc"), ("PRE_ADMISSION_MEDICATION", "thuốc đang dùng"), ("CURRENT_ILLNESS", "bệnh sử"), ("CURRENT_ILLNESS", "diễn tiến"),
    ("ADMISSION_REASON", "lý do"), ("HOSPITAL_ASSESSMENT", "khám"), ("LAB_RESULT", "xét nghiệm"), ("IMAGING_RESULT", "siêu âm"), ("TREATMENT", "kế hoạch"), ("TREATMENT", "điều trị"), ("DIAGNOSIS_FINDING", "chẩn đoán"), ("CURRENT_SYMPTOM", "tóm tắt"),
])]
_MARK = docs.MARKER
_unmark = lambda k: f"trim(regexp_replace({k}, '{_MARK}', ''))"
_begins = lambda t, p: f"({p} <> '' AND (starts_with({t}, {p}) OR starts_with(trim(split_part({t}, ':', 1)), {p})))"
_LIKE = f"(trim(chunk) <> '' AND length(trim(chunk)) <= 160 AND (regexp_matches(trim(chunk), '{_MARK}') OR strpos(trim(chunk), ':') BETWEEN 1 AND 81 OR (upper(trim(chunk)) = trim(chunk) AND lower(trim(chunk)) <> trim(chunk) AND nw <= 12) OR nw <= 10))"
_SECTIONED = (
    f"{CHUNKS}, pat AS (SELECT label, ord, {_unmark(COMPOSED.format('pattern'))} AS p, {_unmark(BARE.format('pattern'))} AS pb FROM (VALUES " + ", ".join(f"('{a}', {i}, '{b}')" for a, i, b in _PATTERNS) + ") t(label, ord, pattern)), "
    f"cx AS (SELECT *, {_unmark(COMPOSED.format('chunk'))} AS k, {_unmark(BARE.format('chunk'))} AS kb, length(trim(chunk)) <= 160 AS short, {_LIKE} AS heading, {_unmark(COMPOSED.format('pre'))} AS pk, {_unmark(BARE.format('pre'))} AS pkb FROM (SELECT *, len(list_filter(regexp_split_to_array(trim(chunk), '\\s+'), lambda w: w <> '')) AS nw, CASE WHEN contains(chunk, ':') THEN left(split_part(chunk, ':', 1), 80) END AS pre FROM chunk)), "
    f"mt AS (SELECT id, chunk_no, label, ord, CASE WHEN k = p THEN {{'n': 1, 'c': 1.0, 'h': 'exact_heading'}} WHEN kb = pb THEN {{'n': 1, 'c': 0.9, 'h': 'exact_no_diacritics_heading'}} WHEN pk = p THEN {{'n': 2, 'c': 1.0, 'h': 'exact_inline'}} WHEN pkb = pb THEN {{'n': 2, 'c': 0.9, 'h': 'exact_no_diacritics_inline'}} WHEN {_begins('pk', 'p')} THEN {{'n': 2, 'c': 0.82, 'h': 'containment_inline'}} WHEN {_begins('pkb', 'pb')} THEN {{'n': 2, 'c': 0.72, 'h': 'containment_no_diacritics_inline'}} "
    f"WHEN heading AND {_begins('k', 'p')} THEN {{'n': 3, 'c': 0.78, 'h': 'containment_heading'}} WHEN short AND {_begins('kb', 'pb')} THEN {{'n': 3, 'c': 0.72, 'h': 'containment_no_diacritics_heading'}} END AS m FROM cx, pat), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, chunk_no ORDER BY m.n, m.c DESC, ord) AS r FROM mt WHERE m IS NOT NULL) WHERE r = 1 AND m.c >= 0.55), "
    "lab AS (SELECT c.id, c.chunk_no, c.line_no, c.start_pos, c.end_pos, c.chunk, b.label, b.m.c AS conf, b.m.h AS how, last_value(CASE WHEN b.label IS NOT NULL THEN {'l': b.label, 'c': b.m.c} END IGNORE NULLS) OVER (PARTITION BY c.id ORDER BY c.chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS la FROM chunk c LEFT JOIN best b USING (id, chunk_no)), "
    f"sec AS (SELECT id, chunk_no, line_no, start_pos, end_pos, coalesce(label, la.l, 'UNKNOWN') AS section, CAST(coalesce(conf, CASE WHEN la IS NOT NULL THEN least(la.c, 0.30) END, 0) AS DOUBLE) AS section_confidence, coalesce(how, CASE WHEN la IS NOT NULL THEN 'carry_forward' END, 'default') AS section_source, CASE WHEN trim(chunk) <> '' AND length(trim(chunk)) <= 120 AND (contains(trim(chunk), ':') OR regexp_matches(trim(chunk), '{_MARK}')) THEN {KEY.format('chunk')} END AS subsection FROM lab)"
)


def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    chunked = docs.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return docs.detect_sections(chunked, spark.createDataFrame(_PATTERNS, "label string, ord int, pattern string"))


@query(f"WITH RECURSIVE {_SECTIONED} SELECT id, chunk_no, section, round(section_confidence, 6) AS section_confidence, section_source, subsection FROM sec")
def section_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _sectioned(spark, sf).select("id", "chunk_no", "section", F.round("section_confidence", 6).alias("section_confidence"), "section_source", "subsection")


@query(f"WITH RECURSIVE {_SECTIONED} SELECT section, section_source, count(*) AS n FROM sec GROUP BY 1, 2")
def section_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _sectioned(spark, sf).groupBy("section", "section_source").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_SECTIONED}, u AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM section OR chunk_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY chunk_no) - 1 AS g FROM (SELECT *, lag(section) OVER (PARTITION BY id ORDER BY chunk_no) AS p FROM sec)) SELECT id, CAST(g AS INTEGER) AS unit_no, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_chunks FROM u GROUP BY 1, 2")
def parent_units(spark: SparkSession, sf: str) -> DataFrame:
    return docs.parent_units(_sectioned(spark, sf), "section")


# --- proposals ---------------------------------------------------------------------------------------------------------

_TOKLAB = f"{TOKENS}, {GOLD}, docu AS (SELECT sample_no AS id, text AS doc FROM calibration WHERE text IS NOT NULL), j AS (SELECT t.id, t.pos, t.start_pos, t.end_pos, min({{'s': s.start_pos, 'y': s.entity_type}}) AS m FROM tok t LEFT JOIN gold_spans s ON t.id = s.id AND t.start_pos >= s.start_pos AND t.end_pos <= s.end_pos GROUP BY 1, 2, 3, 4), lt AS (SELECT id, pos, start_pos, end_pos, m.y AS y, CASE WHEN m.s IS NULL THEN NULL WHEN m.s = start_pos THEN 'B' ELSE 'I' END AS b, 0.5 + (pos * 7 % 10) / 20.0 AS score FROM j)"


@query(f"WITH {_TOKLAB}, k AS (SELECT *, sum(CASE WHEN y IS NOT NULL AND (b = 'B' OR py IS DISTINCT FROM y OR start_pos > pe + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY start_pos, end_pos) AS g FROM (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY start_pos, end_pos) AS py, lag(end_pos) OVER (PARTITION BY id ORDER BY start_pos, end_pos) AS pe FROM lt)), s AS (SELECT id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(y) AS entity_type, avg(score) AS score FROM k WHERE y IS NOT NULL GROUP BY id, g) SELECT id, start_pos, end_pos, entity_type, round(score, 6)::DOUBLE AS score FROM s JOIN docu USING (id) WHERE round(score, 9) >= CASE entity_type WHEN 'THUỐC' THEN 0.6 ELSE 0.7 END AND (entity_type <> 'CHẨN_ĐOÁN' OR end_pos - start_pos <= 40) AND length(substring(doc, start_pos + 1, end_pos - start_pos)) - length(replace(substring(doc, start_pos + 1, end_pos - start_pos), chr(10), '')) < 2")
def token_decoding(spark: SparkSession, sf: str) -> DataFrame:
    """Token labels are the annotations', scores a function of the token's number."""
    from noteweave.operators import audit

    tok = catalog._tokens(spark, sf).select("id", "pos", "start_pos", "end_pos")
    lab = audit.bio_labels(tok, catalog._gold(spark, sf)).withColumn("score", 0.5 + (F.col("pos") * 7 % 10) / 20.0).join(entities._docs(spark, sf), "id")
    d = fusion.decode_tokens(lab, 0.7, {"THUỐC": 0.6}, {"CHẨN_ĐOÁN": 40})
    return d.withColumn("score", F.round("score", 6))


_PROPOSED = catalog.PRED_SQL.replace("WITH ", "", 1) + ", prop AS (SELECT id, start_pos, end_pos, entity_type, 'dictionary' AS pass_name, 'w' || (start_pos // 200) AS window_id, least(0.9, 0.4 + n / 10.0) AS score FROM found UNION ALL SELECT id, start_pos, end_pos, entity_type, 'reviewer', 'w' || (start_pos // 150), 0.5 + (end_pos % 5) / 10.0 FROM gold_spans), kept AS (SELECT * FROM prop WHERE score >= CASE entity_type WHEN 'THUỐC' THEN 0.55 WHEN 'TRIỆU_CHỨNG' THEN 0.7 ELSE 0.6 END)"
_LIMITS = {"THUỐC": 0.55, "TRIỆU_CHỨNG": 0.7}


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    c = ["id", "start_pos", "end_pos", "entity_type"]
    window = lambda n: F.concat(F.lit("w"), F.floor(F.col("start_pos") / n).cast("string")).alias("window_id")
    one = catalog._found(spark, sf).select(*c, F.lit("dictionary").alias("pass_name"), window(200), F.least(F.lit(0.9), 0.4 + F.col("n") / 10.0).alias("score"))
    return one.unionByName(catalog._gold(spark, sf).select(*c, F.lit("reviewer").alias("pass_name"), window(150), (0.5 + F.col("end_pos") % 5 / 10.0).alias("score")))


@query(f"WITH {_PROPOSED}, best AS (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos, entity_type ORDER BY score DESC, pass_name DESC, window_id DESC) AS r FROM kept), g AS (SELECT id, start_pos, end_pos, entity_type, string_agg(DISTINCT pass_name, '|' ORDER BY pass_name) AS passes, string_agg(DISTINCT window_id, '|' ORDER BY window_id) AS windows, count(*) AS agreement FROM kept GROUP BY 1, 2, 3, 4) SELECT id, start_pos, end_pos, entity_type, round(score, 6)::DOUBLE AS score, pass_name, window_id, passes, windows, agreement FROM g JOIN (SELECT * FROM best WHERE r = 1) USING (id, start_pos, end_pos, entity_type)")
def proposal_merge(spark: SparkSession, sf: str) -> DataFrame:
    floor = fusion.inference_floor(0.6, _LIMITS)
    kept = fusion.over_threshold(_proposals(spark, sf).filter(F.col("score") >= floor), 0.6, _LIMITS)
    return fusion.merge_proposals(kept).withColumn("score", F.round("score", 6))


@query(f"WITH {_PROPOSED}, a AS (SELECT * FROM prop WHERE score >= 0.55), b AS (SELECT * FROM a WHERE score >= CASE entity_type WHEN 'THUỐC' THEN 0.55 WHEN 'TRIỆU_CHỨNG' THEN 0.7 ELSE 0.6 END) SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM kept)) AS only_floor, (SELECT count(*) FROM (SELECT * FROM kept EXCEPT ALL SELECT * FROM b)) AS only_direct")
def floor_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    p = _proposals(spark, sf)
    a = fusion.over_threshold(p.filter(F.col("score") >= fusion.inference_floor(0.6, _LIMITS)), 0.6, _LIMITS)
    b = fusion.over_threshold(p, 0.6, _LIMITS)
    return a.exceptAll(b).agg(F.count("*").alias("only_floor")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_direct")))  # one row each


_SPANS_N = "cand AS (SELECT id, start_pos, end_pos, entity_type, pass_name AS source, max(score) AS score FROM prop GROUP BY 1, 2, 3, 4, 5), ordd AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos DESC, score DESC, entity_type, source) AS k FROM cand), walk AS (SELECT id, CAST(0 AS BIGINT) AS k, -1 AS e, false AS kept FROM (SELECT DISTINCT id FROM ordd) UNION ALL SELECT w.id, o.k, CASE WHEN o.start_pos >= w.e THEN o.end_pos ELSE w.e END, o.start_pos >= w.e FROM walk w JOIN ordd o ON o.id = w.id AND o.k = w.k + 1)"


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    return _proposals(spark, sf).withColumnRenamed("pass_name", "source").groupBy("id", "start_pos", "end_pos", "entity_type", "source").agg(F.max("score").alias("score"))


@query(f"WITH RECURSIVE {_PROPOSED}, {_SPANS_N} SELECT o.id, o.start_pos, o.end_pos, o.entity_type, o.source, round(o.score, 6)::DOUBLE AS score FROM ordd o JOIN walk w USING (id, k) WHERE w.kept")
def greedy_non_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.non_overlapping(_sourced(spark, sf)).withColumn("score", F.round("score", 6))


_TWO = "mdl AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type) - 1 AS INTEGER) AS no, start_pos, end_pos, entity_type FROM (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM found)), xpt AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type) - 1 AS INTEGER) AS no, start_pos, end_pos, entity_type FROM (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM gold_spans))"
_EX = "a.start_pos = b.start_pos AND a.end_pos = b.end_pos"
_COMP = f"{_TWO}, ce AS (SELECT a.id, a.no AS pred_no, b.no AS gold_no, {_IOU} AS iou, CASE WHEN {_EX} AND a.entity_type = b.entity_type THEN 0 WHEN {_EX} THEN 1 WHEN a.entity_type = b.entity_type THEN 2 ELSE 3 END AS rank FROM {_over('mdl', 'xpt')} WHERE ({_EX}) OR {_IOU} >= 0.5), " + greedy_sql("ce", "rank, iou DESC", "cg") + ", comp AS (SELECT id, ['exact_agreement', 'exact_type_conflict', 'near_overlap_agreement', 'near_overlap_type_conflict'][rank + 1] AS category, pred_no AS model_no, gold_no AS expert_no FROM cg UNION ALL SELECT id, 'model_only', no, -1 FROM mdl WHERE (id, no) NOT IN (SELECT id, pred_no FROM cg) UNION ALL SELECT id, 'expert_only', -1, no FROM xpt WHERE (id, no) NOT IN (SELECT id, gold_no FROM cg))"


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = ["id", "start_pos", "end_pos", "entity_type"]
    one = lambda d, s: fusion.canonical(d.select(c).withColumn("source", F.lit(s)).withColumn("score", F.lit(1.0))).drop("score", "source")
    return one(catalog._found(spark, sf), "model"), one(catalog._gold(spark, sf), "expert")


@query(f"WITH RECURSIVE {catalog.PRED_SQL.replace('WITH ', '', 1)}, {_COMP} SELECT * FROM comp")
def complementarity(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.complementarity(*_two(spark, sf))


@query(f"WITH RECURSIVE {catalog.PRED_SQL.replace('WITH ', '', 1)}, {_COMP} SELECT category, count(*) AS n FROM comp GROUP BY ROLLUP (category)")
def complementarity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.complementarity(*_two(spark, sf)).rollup("category").agg(F.count("*").alias("n"))


@query(f"WITH {catalog.PRED_SQL.replace('WITH ', '', 1)}, {_TWO}, fin AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM mdl WHERE entity_type <> 'THUỐC'), al AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM mdl m WHERE NOT EXISTS (SELECT 1 FROM xpt x WHERE x.id = m.id AND m.start_pos < x.end_pos AND x.start_pos < m.end_pos)) SELECT al.*, fin.id IS NOT NULL AS survives FROM al LEFT JOIN fin ON fin.id = al.id AND fin.start_pos = al.start_pos AND fin.end_pos = al.end_pos AND fin.entity_type = al.entity_type")
def unconfirmed_survival(spark: SparkSession, sf: str) -> DataFrame:
    m, x = _two(spark, sf)
    return fusion.unconfirmed(m, x, m.filter("entity_type != 'THUỐC'"))


_EVID = "ev AS (SELECT row_number() OVER (ORDER BY id, start_pos, end_pos, entity_type, pass_name, score) AS n, *, CASE WHEN pass_name = 'dictionary' THEN 'dictionary' WHEN entity_type = 'THUỐC' THEN 'drug_rule' WHEN entity_type = 'TÊN_XÉT_NGHIỆM' THEN 'lab_rule' WHEN entity_type = 'KẾT_QUẢ_XÉT_NGHIỆM' THEN 'lab_result_rule' ELSE 'gliner' END AS source FROM prop)"
_case = lambda d, c, other: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + f" ELSE {other} END"


@query(f"WITH {_PROPOSED}, {_EVID} SELECT source, {_case(fusion.FAMILY, 'source', chr(39) + 'other' + chr(39))} AS ev_family, {_case(fusion.ROLE, 'source', chr(39) + 'proposal' + chr(39))} AS ev_role, CASE WHEN source = 'gliner' THEN 'gliner_probability' ELSE '{fusion.RULE_SCORE}' END AS ev_score_kind, {_case(fusion.ANCHOR, 'source', 'NULL')} AS ev_anchor, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4, 5")
def evidence_families(spark: SparkSession, sf: str) -> DataFrame:
    d = fusion.with_evidence(_sources_of(spark, sf))
    return d.groupBy("source", "ev_family", "ev_role", "ev_score_kind", "ev_anchor").agg(F.count("*").alias("n"))


def _sources_of(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("entity_type")
    source = F.when(F.col("pass_name") == "dictionary", "dictionary").when(y == "THUỐC", "drug_rule").when(y == "TÊN_XÉT_NGHIỆM", "lab_rule").when(y == "KẾT_QUẢ_XÉT_NGHIỆM", "lab_result_rule").otherwise("gliner")
    return _proposals(spark, sf).withColumn("source", source).withColumn("raw_type", y).withColumn("pair_id", F.lit(None).cast("string")).withColumn("pattern", F.lit(""))


@query(f"WITH {_PROPOSED}, {_EVID} SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN id % 5 = 0 AND source <> 'dictionary' THEN 'evidence_source_mismatch' END, CASE WHEN id % 7 = 0 THEN 'evidence_score_mismatch' END], lambda c: c IS NOT NULL)) AS code FROM ev) GROUP BY 1")
def evidence_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every fifth note names the dictionary as its source, of every seventh another score."""
    d = fusion.with_evidence(_sources_of(spark, sf)).withColumn("row", F.col("id"))
    d = d.withColumn("ev_source", F.when(F.col("id") % 5 == 0, "dictionary").otherwise(F.col("ev_source"))).withColumn("ev_score", F.when(F.col("id") % 7 == 0, F.col("ev_score") + 1).otherwise(F.col("ev_score")))
    return fusion.evidence_issues(d).groupBy("code").agg(F.count("*").alias("n"))
