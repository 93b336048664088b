"""Queries on entities: cues and assertions, trimming and dropping, duplicates, overlaps, contexts, type evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import assertions, cleanup, evidence, views
from noteweave.plans import catalog
from noteweave.plans.base import KEY, query, table
from noteweave.plans.catalog import GOLD

W = r"[\pL\pN_]"
_TEXTS = "doc AS (SELECT sample_no AS id, text AS doc FROM calibration WHERE text IS NOT NULL)"
_RULES = "cue_rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, cs in assertions.RULES.items() for c in cs) + ") t(kind, cue))"
_HITS = (
    f"{catalog.TOKENS}, {_RULES}, cues AS (SELECT kind, cue, len(regexp_extract_all(cue, '{W}+')) AS n, regexp_extract(cue, '{W}+') AS first FROM cue_rules), whole AS (SELECT id, list(lower(token) ORDER BY pos) AS ks, list(start_pos ORDER BY pos) AS ss, list(end_pos ORDER BY pos) AS es FROM tok GROUP BY id), "
    f"starts AS (SELECT id, ss, es, unnest(ks) AS first, generate_subscripts(ks, 1) AS i FROM whole), {_TEXTS}, hits AS (SELECT s.id, kind, cue, s.ss[i] AS start_pos, s.es[i + n - 1] AS end_pos FROM starts s JOIN cues USING (first) JOIN doc USING (id) WHERE s.es[i + n - 1] IS NOT NULL AND lower(substring(doc, s.ss[i] + 1, s.es[i + n - 1] - s.ss[i])) = cue)"
)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "calibration").filter("text is not null").select(F.col("sample_no").alias("id"), F.col("text").alias("doc"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Different annotated spans with their text."""
    return catalog._gold(spark, sf).select("id", "start_pos", "end_pos", "entity_type", "text").distinct()


_SPANS = f"{GOLD}, spans AS (SELECT DISTINCT id, start_pos, end_pos, entity_type, text FROM gold_spans)"


@query(f"WITH {_HITS} SELECT id, kind, cue, start_pos, end_pos FROM hits")
def cue_hits(spark: SparkSession, sf: str) -> DataFrame:
    return assertions.cue_hits(table(spark, sf, "calibration"), "sample_no", "text")


_of = lambda kind: f"list_filter(hs, lambda h: h.kind = '{kind}')"
_ANY = "len(list_filter({0}, lambda {1}: {2})) > 0"
_cut = lambda a, b: f"substring(doc, CAST({a} + 1 AS BIGINT), CAST(greatest({b} - {a}, 0) AS BIGINT))"
_ended = lambda part: f"regexp_matches(lower({part}), '[.;\\n]|(?:^|[^\\pL\\pN_])(?:{assertions.TERMINATOR_WORDS})(?:[^\\pL\\pN_]|$)')"
_subject = lambda part: f"(contains({part}, ',') AND regexp_matches({KEY.format(part)}, '{assertions.SUBJECTS}'))"
_LOW = "greatest(s - 160, 0)"
_PSEUDO = _ANY.format(_of("pseudo_negation"), "p", f"p.a >= greatest({_LOW}, x.a - 30) AND p.b <= s AND p.a < x.b AND p.b > x.a")
_PAST = f"list_filter(hs, lambda h: h.kind = 'historical' AND h.a >= {_LOW} AND h.b <= e + 160)"
_APPLIES = f"(entity_type = 'THUỐC' OR NOT regexp_matches(x.cue, '{assertions.DRUG_CUES}'))"
_LADDER = "CASE WHEN entity_type = 'THUỐC' AND regexp_matches(x.cue, 'trước khi nhập viện|tại nhà') THEN 0.90 WHEN regexp_matches(x.cue, 'tiền sử|đã từng|trước đây') THEN 0.88 WHEN regexp_matches(x.cue, 'ngừng|cách nhập viện') THEN 0.84 ELSE 0.75 END"
_inside = lambda kind, a, b: _ANY.format(_of(kind), "y", f"y.a >= {a} AND y.b <= {b}")
ASSERTED = (
    f"{_HITS}, {_SPANS}, arr AS (SELECT id, list({{'a': start_pos, 'b': end_pos, 'kind': kind, 'cue': cue}} ORDER BY start_pos, end_pos, kind, cue) AS hs FROM hits GROUP BY id), ent AS (SELECT g.id, g.start_pos AS s, g.end_pos AS e, g.entity_type, d.doc, coalesce(list_filter(a.hs, lambda h: h.b > g.start_pos - 160 AND h.a < g.end_pos + 160), []) AS hs FROM spans g JOIN doc d USING (id) LEFT JOIN arr a USING (id)), "
    f"sc AS (SELECT id, s, e, entity_type, CASE WHEN {_ANY.format(_of('negation_pre'), 'x', f'x.a >= {_LOW} AND x.b <= s AND s - x.b <= 90 AND NOT {_PSEUDO} AND NOT {_ended(_cut(chr(120) + chr(46) + chr(98), chr(115)))} AND NOT {_subject(_cut(chr(120) + chr(46) + chr(98), chr(115)))}')} THEN 0.90 WHEN {_ANY.format(_of('negation_post'), 'x', f'x.a >= e AND x.a - e <= 48 AND x.b <= e + 160 AND NOT {_ended(_cut(chr(101), chr(120) + chr(46) + chr(97)))}')} THEN 0.72 ELSE 0 END AS negation, "
    f"CASE WHEN {_ANY.format(_of('current'), 'c', 'c.a >= s - 100 AND c.b <= e + 60 AND NOT ' + _ANY.format(_PAST, 'x', 'x.a < c.b AND c.a < x.b'))} THEN 0 ELSE coalesce(list_min(list_transform(list_filter({_PAST}, lambda x: x.b <= s AND {_APPLIES} AND NOT {_ended(_cut('x.b', 's'))}), lambda x: {{'d': s - x.b, 'a': x.a, 'score': {_LADDER}}})).score, CASE WHEN {_ANY.format(_PAST, 'x', f'x.a >= e AND {_APPLIES} AND NOT ' + _ended(_cut('e', 'x.a')))} THEN 0.70 END, 0) END AS history, "
    f"CASE WHEN {_ANY.format(_of('family'), 'x', f'x.a >= {_LOW} AND x.b <= s AND NOT ' + _ended(_cut('x.b', 's')) + ' AND NOT ' + _inside('reporter', 'x.b', 's') + ' AND NOT ' + _inside('patient', 'x.b', 's') + ' AND ' + _inside('experiencer', 'x.b', 'e + 40'))} THEN 0.90 ELSE 0 END AS family FROM ent)"
)
_MARKS = "array_to_string(list_filter([CASE WHEN negation >= 0.55 THEN 'isNegated' END, CASE WHEN history >= 0.60 THEN 'isHistorical' END, CASE WHEN family >= 0.80 THEN 'isFamily' END], lambda m: m IS NOT NULL AND entity_type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC')), '|')"


@query(f"WITH {ASSERTED} SELECT id, s AS start_pos, e AS end_pos, entity_type, CAST(negation AS DOUBLE) AS negation, CAST(history AS DOUBLE) AS history, CAST(family AS DOUBLE) AS family, {_MARKS} AS assertions FROM sc")
def assertion_scopes(spark: SparkSession, sf: str) -> DataFrame:
    hits = assertions.cue_hits(table(spark, sf, "calibration"), "sample_no", "text")
    d = assertions.assert_entities(_spans(spark, sf).drop("text"), _docs(spark, sf), hits)
    return d.withColumn("assertions", F.array_join("assertions", "|"))


# --- contexts ----------------------------------------------------------------------------------------------------------

_ctx = lambda w: f"substring(doc, CAST(greatest(0, start_pos - {w}) + 1 AS BIGINT), CAST(start_pos - greatest(0, start_pos - {w}) AS BIGINT))"
_SLICE = "substring(doc, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT))"


@query(
    f"WITH {_SPANS}, {_TEXTS} SELECT id, start_pos, end_pos, entity_type, {_ctx(80)} AS left_80, substring(doc, CAST(end_pos + 1 AS BIGINT), 80) AS right_80, regexp_extract({_ctx(80)}, '([^.!?\\n\\r]*)$', 1) || {_SLICE} || regexp_extract(substring(doc, CAST(end_pos + 1 AS BIGINT), 80), '^[^.!?\\n\\r]*') AS sentence, "
    "CASE WHEN start_pos < 0 OR end_pos <= start_pos OR end_pos > length(doc) THEN 'out_of_bounds' WHEN " + _SLICE + " <> text THEN 'offset_mismatch' ELSE '' END AS issue FROM spans JOIN doc USING (id)"
)
def span_contexts(spark: SparkSession, sf: str) -> DataFrame:
    d = _spans(spark, sf).join(_docs(spark, sf), "id")
    doc, s, e = F.col("doc"), F.col("start_pos"), F.col("end_pos")
    left, right = views.context(doc, s, e, 80)
    issue = F.when((s < 0) | (e <= s) | (e > F.length(doc)), "out_of_bounds").when(views.slice_differs(doc, s, e, F.col("text")), "offset_mismatch").otherwise("")
    return d.select("id", "start_pos", "end_pos", "entity_type", left.alias("left_80"), right.alias("right_80"), views.sentence_around(doc, s, e).alias("sentence"), issue.alias("issue"))


# --- trimming and dropping ---------------------------------------------------------------------------------------------

_E = cleanup.EDGE.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n")
_REST = "substring(doc, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))"


def _heads(key: str, heads: list[str]) -> str:
    return f"regexp_matches({key}, '^(?:{'|'.join(heads)})(?: |$)')"


def _after(cues: list[str], heads: list[str] | None) -> str:
    out = "CASE"
    for cue in sorted(cues, key=len, reverse=True):
        past = f"({len(cue)} + length(regexp_extract(substring(rest, {len(cue) + 1}), '^[{_E}]*')))"
        more = f" AND {_heads(KEY.format(f'substring(rest, {past} + 1)'), heads)}" if heads else ""
        out += f" WHEN starts_with({KEY.format('rest')}, '{cue} '){more} THEN {past}"
    return out + " ELSE 0 END"


_TRIM = lambda a, b: f"(SELECT {{'x': least({a} + l, {b}), 'y': greatest({b} - r, least({a} + l, {b}))}} FROM (SELECT length(regexp_extract(z, '^[{_E}]*')) AS l, length(regexp_extract(z, '([{_E}]*)$', 1)) AS r FROM (SELECT substring(doc, CAST({a} + 1 AS BIGINT), CAST({b} - {a} AS BIGINT)) AS z)))"
_WIDE = "wide AS (SELECT id, greatest(0, start_pos - k) AS start_pos, least(length(doc), end_pos + k // 4) AS end_pos, entity_type, doc FROM spans JOIN doc USING (id), (SELECT unnest([0, 5, 9, 14]) AS k))"
TRIMMED = (
    f"{_SPANS}, {_TEXTS}, {_WIDE}, t1 AS (SELECT *, t.x AS a, t.y AS b FROM (SELECT *, {_TRIM('start_pos', 'end_pos')} AS t FROM wide)), t2 AS (SELECT * EXCLUDE (a, n), a + n AS a, n FROM (SELECT *, CASE WHEN entity_type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC') THEN {_after(cleanup.NEGATION_CUES, None)} ELSE 0 END AS n FROM (SELECT *, {_REST} AS rest FROM t1))), "
    f"t3 AS (SELECT * EXCLUDE (a, rest), a + CASE WHEN entity_type = 'CHẨN_ĐOÁN' THEN {_after(cleanup.DIAGNOSIS_TRIGGERS, cleanup.DISEASE_HEADS)} ELSE 0 END AS a FROM (SELECT * EXCLUDE rest, {_REST} AS rest FROM t2)), "
    f"t4 AS (SELECT * EXCLUDE (a, rest), a + CASE WHEN entity_type = 'TRIỆU_CHỨNG' THEN {_after(cleanup.SUBJECT_TRIGGERS, cleanup.SYMPTOM_HEADS)} WHEN entity_type = 'CHẨN_ĐOÁN' THEN {_after(cleanup.SUBJECT_TRIGGERS, cleanup.DISEASE_HEADS)} ELSE 0 END AS a FROM (SELECT *, {_REST} AS rest FROM t3)), t5 AS (SELECT * EXCLUDE t, {_TRIM('a', 'b')} AS t FROM t4)"
)


def _widened(spark: SparkSession, sf: str) -> DataFrame:
    """Spans with up to 14 characters more before and 3 after, so there is something to trim."""
    d = _spans(spark, sf).drop("text").join(_docs(spark, sf), "id").withColumn("k", F.explode(F.array(*map(F.lit, (0, 5, 9, 14)))))
    d = d.withColumn("start_pos", F.greatest(F.lit(0), F.col("start_pos") - F.col("k"))).withColumn("end_pos", F.least(F.length("doc"), F.col("end_pos") + F.floor(F.col("k") / 4).cast("int")))
    return d.withColumn("assertions", F.array().cast("array<string>")).withColumn("before", F.col("start_pos"))


@query(f"WITH {TRIMMED} SELECT id, entity_type, start_pos AS before, CASE WHEN t.x < t.y THEN t.x ELSE start_pos END AS start_pos, CASE WHEN t.x < t.y THEN t.y ELSE end_pos END AS end_pos, CASE WHEN t.x < t.y AND n > 0 THEN 'isNegated' ELSE '' END AS assertions FROM t5")
def span_trim(spark: SparkSession, sf: str) -> DataFrame:
    return cleanup.trim_spans(_widened(spark, sf)).select("id", "entity_type", "before", "start_pos", "end_pos", F.array_join("assertions", "|").alias("assertions"))


_K = KEY.format("text")
_SENT = f"regexp_extract({_ctx(80)}, '([^.!?\\n\\r]*)$', 1) || {_SLICE} || regexp_extract(substring(doc, CAST(end_pos + 1 AS BIGINT), 80), '^[^.!?\\n\\r]*')"
_NOTMED = f"replace(replace({KEY.format(_SENT)}, 'thuốc lá', ' '), 'hút thuốc', ' ')"


@query(
    f"WITH {_SPANS}, {_TEXTS} SELECT id, start_pos, end_pos, entity_type, CASE WHEN entity_type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN') AND ({_K} IN ('" + "', '".join(cleanup.GENERIC) + f"') OR regexp_matches({_K}, '^(?:bệnh nhân|người bệnh) ') OR (starts_with({_K}, 'bệnh ') AND len(string_split({_K}, ' ')) <= 2)) THEN 'generic_problem_phrase' WHEN entity_type <> 'KẾT_QUẢ_XÉT_NGHIỆM' AND {_K} IN ('" + "', '".join(cleanup.RESULT_WORDS) + "') THEN 'non_lab_qualitative_result' "
    f"WHEN entity_type = 'THUỐC' AND NOT regexp_matches(lower(text), '\\d ?(?:mg|mcg|g|ml|%)') AND regexp_matches({KEY.format(_SENT)}, '{'|'.join(cleanup.SUBSTANCES)}') AND NOT regexp_matches({_NOTMED}, '{'|'.join(cleanup.MEDICATION_CUES)}') THEN 'drug_without_dose_in_food_or_substance_context' ELSE '' END AS reason FROM spans JOIN doc USING (id)"
)
def drop_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = _spans(spark, sf).join(_docs(spark, sf), "id")
    return d.select("id", "start_pos", "end_pos", "entity_type", cleanup.drop_reason(F.lower("text").rlike(r"\d ?(?:mg|mcg|g|ml|%)")).alias("reason"))


# --- duplicates, attributes, overlaps ----------------------------------------------------------------------------------

_ORDERED = "list_filter(['isNegated', 'isFamily', 'isHistorical'], lambda z: list_contains({0}, z))"
_RECORDS = "SELECT file_id AS id, record_id AS row, span[1] AS start_pos, span[2] AS end_pos, entity_type, coalesce(assertions, []) AS assertions, coalesce(candidates, []) AS candidates, (rec_no % 7) / 10.0 AS confidence, length(coalesce(annotator, '')) AS source_rank FROM gold WHERE len(span) = 2"
_STABLE = "list_filter(list_transform({0}, lambda v: trim(v)), lambda v: v <> '')"
_DISTINCT = "list_filter({0}, lambda v, i: list_position({0}, v) = i)".format(_STABLE)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold").filter("size(span) = 2")
    return g.select(F.col("file_id").alias("id"), F.col("record_id").alias("row"), F.col("span")[0].alias("start_pos"), F.col("span")[1].alias("end_pos"), "entity_type", "text", "assertions", "candidates", (F.col("rec_no") % 7 / 10.0).alias("confidence"), F.length(F.coalesce("annotator", F.lit(""))).alias("source_rank"))


@query(f"WITH r AS ({_RECORDS}), g AS (SELECT id, start_pos, end_pos, entity_type, max({{'c': confidence, 's': source_rank, 'n': len(candidates), 'r': -row}}) AS best, flatten(list(assertions ORDER BY row)) AS a, flatten(list(candidates ORDER BY row)) AS c, max(confidence) AS confidence, count(*) AS n_merged FROM r GROUP BY 1, 2, 3, 4) SELECT id, start_pos, end_pos, entity_type, -best.r AS row, array_to_string({_ORDERED.format('a')}, '|') AS assertions, array_to_string({_DISTINCT.format('c')}, '|') AS candidates, confidence::DOUBLE AS confidence, n_merged FROM g")
def merge_exact_entities(spark: SparkSession, sf: str) -> DataFrame:
    m = cleanup.merge_exact(_records(spark, sf))
    return m.withColumn("assertions", F.array_join("assertions", "|")).withColumn("candidates", F.array_join("candidates", "|"))


@query(f"WITH r AS (SELECT *, {_ORDERED.format('assertions')} AS oa, {_DISTINCT.format('candidates')} AS oc FROM ({_RECORDS})) SELECT row, CASE WHEN entity_type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC') THEN array_to_string(oa, '|') ELSE '' END AS assertions, CASE WHEN entity_type IN ('CHẨN_ĐOÁN', 'THUỐC') THEN array_to_string(oc, '|') ELSE '' END AS candidates FROM r")
def attribute_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    d = cleanup.clean_attributes(_records(spark, sf))
    return d.select("row", F.array_join("assertions", "|").alias("assertions"), F.array_join("candidates", "|").alias("candidates"))


_RANK = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cleanup.TYPE_ORDER.items()) + " ELSE 999 END"
_NUMBERED = f"{_SPANS}, num AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type) AS INTEGER) AS row FROM spans)"


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return _spans(spark, sf).withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy("start_pos", "end_pos", "entity_type")))


@query(f"WITH {_NUMBERED} SELECT id, row, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, {_RANK}, text, row) AS INTEGER) AS place FROM num")
def output_order(spark: SparkSession, sf: str) -> DataFrame:
    return cleanup.final_order(_numbered(spark, sf)).select("id", "row", "place")


_ALL = catalog.PRED_SQL.replace("WITH ", "", 1) + f", every AS (SELECT id, start_pos, end_pos, entity_type, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type) AS INTEGER) AS row FROM (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM (SELECT id, start_pos, end_pos, entity_type FROM found UNION ALL SELECT id, start_pos, end_pos, entity_type FROM gold_spans)))"


def _everything(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary spans and annotated ones, numbered within their text."""
    from pyspark.sql import Window

    c = ["id", "start_pos", "end_pos", "entity_type"]
    d = catalog._found(spark, sf).select(c).unionByName(catalog._gold(spark, sf).select(c)).distinct()
    return d.withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy("start_pos", "end_pos", "entity_type")))


@query(f"WITH {_ALL} SELECT a.id, count(*) AS n FROM every a JOIN every b ON a.id = b.id AND (a.start_pos, a.end_pos, a.row) < (b.start_pos, b.end_pos, b.row) AND b.start_pos < a.end_pos GROUP BY 1")
def remaining_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return cleanup.remaining_overlaps(_everything(spark, sf))


@query()
def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    d = _everything(spark, sf).join(_docs(spark, sf), "id")
    key = tx.lookup_key(F.substring("doc", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")))
    d = d.withColumn("k", key).withColumns({
        "confidence": F.lit(0.7), "by_rule": F.lit(False), "n_codes": F.lit(0), "n_slots": F.lit(0), "plain": ~F.col("k").rlike("[.;]"),
        "disease_head": cleanup.begins_with_any(F.col("k"), cleanup.DISEASE_HEADS), "symptom_head": cleanup.begins_with_any(F.col("k"), cleanup.SYMPTOM_HEADS),
    })
    return cleanup.resolve_overlaps(d)


# --- type evidence -----------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of four sources: dictionary, drug rule, a model (the annotations) and an unknown one."""
    f = catalog._found(spark, sf)
    g = catalog._gold(spark, sf)
    c = ["id", "start_pos", "end_pos"]
    parts = [
        f.filter("entity_type != 'THUỐC'").select(*c, F.col("entity_type").alias("raw_type"), F.lit("dictionary").alias("source"), F.lit(0.70).alias("score")),
        f.filter("entity_type = 'THUỐC'").select(*c, F.lit("THUỐC").alias("raw_type"), F.lit("drug_rule").alias("source"), F.lit(0.78).alias("score")),
        g.select(*c, F.col("entity_type").alias("raw_type"), F.lit("ner").alias("source"), F.lit(0.9).alias("score")),
        g.filter("entity_type like '%XÉT_NGHIỆM'").select(*c, F.lit("other").alias("raw_type"), F.when(F.col("entity_type") == "TÊN_XÉT_NGHIỆM", "lab_rule").otherwise("lab_result_rule").alias("source"), F.lit(0.82).alias("score")),
        g.filter("entity_type = 'TRIỆU_CHỨNG'").select(*c, F.lit(None).cast("string").alias("raw_type"), F.lit("problem_rule").alias("source"), F.lit(0.76).alias("score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return evidence.best_scores(out).join(_docs(spark, sf), "id")


_CAND = (
    catalog.PRED_SQL.replace("WITH ", "", 1) + f", {_TEXTS}, raw_c AS (SELECT id, start_pos, end_pos, entity_type AS raw_type, 'dictionary' AS source, 0.70 AS score FROM found WHERE entity_type <> 'THUỐC' UNION ALL SELECT id, start_pos, end_pos, 'THUỐC', 'drug_rule', 0.78 FROM found WHERE entity_type = 'THUỐC' UNION ALL SELECT id, start_pos, end_pos, entity_type, 'ner', 0.9 FROM gold_spans UNION ALL SELECT id, start_pos, end_pos, 'other', CASE WHEN entity_type = 'TÊN_XÉT_NGHIỆM' THEN 'lab_rule' ELSE 'lab_result_rule' END, 0.82 FROM gold_spans WHERE entity_type LIKE '%XÉT_NGHIỆM' UNION ALL SELECT id, start_pos, end_pos, NULL, 'problem_rule', 0.76 FROM gold_spans WHERE entity_type = 'TRIỆU_CHỨNG'), "
    f"cand AS (SELECT id, start_pos, end_pos, raw_type, source, max(score) AS score FROM raw_c GROUP BY 1, 2, 3, 4, 5), ev AS (SELECT c.*, {KEY.format(_SLICE)} AS k, {KEY.format(_ctx(80) + chr(32) + '||' + chr(39) + ' ' + chr(39) + '||' + _SLICE + '||' + chr(39) + ' ' + chr(39) + '|| substring(doc, CAST(end_pos + 1 AS BIGINT), 80)')} AS around FROM cand c JOIN doc USING (id)), "
    f"fl AS (SELECT *, regexp_matches(around, '{'|'.join(evidence.DRUG_CUES)}') AS has_drug_context, {_heads('k', cleanup.SYMPTOM_HEADS)} AS has_symptom_head, {_heads('k', cleanup.DISEASE_HEADS)} AND k NOT IN ('" + "', '".join(evidence.NO_DISEASE) + "') AND NOT regexp_matches(k, '^(?:bệnh nhân|người bệnh) ') AS has_disease_head FROM ev), "
    "re AS (SELECT *, CASE WHEN source = 'lab_result_rule' THEN 'lab_result_rule' WHEN source IN ('lab_rule', 'imaging_rule') THEN source WHEN source = 'drug_rule' THEN CASE WHEN has_drug_context THEN 'drug_rule_with_context' ELSE 'drug_rule_without_context' END WHEN source = 'dictionary' AND raw_type IN (" + ", ".join(f"'{t}'" for t in evidence.TYPES) + ") THEN 'dictionary' WHEN source = 'problem_rule' AND has_disease_head THEN 'problem_disease_head' WHEN source = 'problem_rule' AND has_symptom_head THEN 'problem_symptom_head' "
    "WHEN source IN ('ner', 'gliner') AND raw_type IN (" + ", ".join(f"'{t}'" for t in evidence.TYPES) + ") THEN 'ner_fallback' WHEN raw_type IN (" + ", ".join(f"'{t}'" for t in evidence.TYPES) + ") THEN 'fallback' END AS reason FROM fl), "
    "res AS (SELECT *, CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.REASON_TYPE.items()) + " ELSE CASE WHEN reason IS NOT NULL THEN raw_type END END AS entity_type, CASE reason " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.CONFIDENCE.items()) + " END AS confidence FROM re)"
)


@query(f"WITH {_CAND} SELECT id, start_pos, end_pos, source, has_drug_context, has_symptom_head, has_disease_head, coalesce(entity_type, '') AS entity_type, coalesce(reason, 'invalid_or_missing_raw_type') AS reason, coalesce(confidence, 0)::DOUBLE AS confidence, CASE WHEN entity_type = 'THUỐC' AND NOT has_drug_context THEN 'drug_without_context' WHEN reason = 'fallback' THEN 'fallback_raw_type' ELSE '' END AS warning FROM res")
def type_evidence(spark: SparkSession, sf: str) -> DataFrame:
    d = evidence.resolve(_candidates(spark, sf))
    return d.select("id", "start_pos", "end_pos", "source", "has_drug_context", "has_symptom_head", "has_disease_head", F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.coalesce("reason", F.lit("invalid_or_missing_raw_type")).alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "warning")


_TP = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.TYPE_PRIORITY.items()) + " ELSE 0 END"
_SP = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.SOURCE_PRIORITY.items()) + " ELSE 0 END"


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos ORDER BY {_TP} DESC, confidence DESC, score DESC, {_SP} DESC, source) AS r, string_agg(source, '|') OVER (PARTITION BY id, start_pos, end_pos ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sources, list_distinct(list(entity_type) OVER (PARTITION BY id, start_pos, end_pos)) AS types FROM res WHERE entity_type IS NOT NULL) SELECT id, start_pos, end_pos, entity_type, confidence::DOUBLE AS confidence, source AS chosen_source, reason, sources, CAST(len(types) AS INTEGER) AS n_types FROM r WHERE r = 1")
def type_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.choose(evidence.resolve(_candidates(spark, sf)).filter("entity_type is not null"))
