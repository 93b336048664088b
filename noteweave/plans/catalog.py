"""The core queries and their SQL, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import audit, docs, extract, retrieval, spans, units
from noteweave.plans.base import FOLD, KEY, QUERIES, SQL, Query, query
from noteweave.plans.base import WORDS as _WORDS
from noteweave.plans.base import table as _table
from noteweave.sources import files

HEADINGS = [("history", "tien su|history"), ("medication", "thuoc|medication"), ("course", "dien tien|dien bien"), ("plan", "ke hoach|plan"), ("summary", "tom tat|ghi chu")]
PRIORITY = {"THUỐC": 0, "CHẨN_ĐOÁN": 1, "TRIỆU_CHỨNG": 2, "TÊN_XÉT_NGHIỆM": 3, "KẾT_QUẢ_XÉT_NGHIỆM": 4}


# --- shared inputs ---------------------------------------------------------------------------------------------------

TOKENS = (
    "seg AS (SELECT sample_no AS id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')) AS token, generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), 1) AS i FROM calibration WHERE text IS NOT NULL), "
    "placed AS (SELECT id, i, token, coalesce(sum(length(token)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM seg), "
    "tok AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS pos, token, CAST(start_pos AS INTEGER) AS start_pos, CAST(start_pos + length(token) AS INTEGER) AS end_pos, " + FOLD.format("lower(token)") + " AS key FROM placed WHERE regexp_matches(token, '[\\p{L}\\p{N}_]+'))"
)
GOLD = "gold_spans AS (SELECT sample_no AS id, e.start_pos AS start_pos, e.end_pos AS end_pos, e.entity_type AS entity_type, e.text AS text FROM (SELECT sample_no, unnest(entities) AS e FROM calibration))"


def _phrases_sql(name: str, source: str, column: str, kind: str, alias: str | None = None) -> str:
    rows = f"SELECT 0 AS other, {column} AS canonical, {column} AS p FROM {source}"
    if alias:
        rows += f" UNION ALL SELECT 1, coalesce({column}, {alias}), {alias} FROM {source}"
    return f"{name} AS (SELECT array_to_string(w, ' ') AS key, len(w) AS n, w[1] AS first, '{kind}' AS entity_type, min({{'other': other, 'canonical': canonical}}).canonical AS canonical FROM (SELECT *, {_WORDS.format('p')} AS w FROM ({rows}) WHERE p IS NOT NULL AND length(trim(p)) <= 80) WHERE len(w) > 0 GROUP BY 1, 2, 3 HAVING length(array_to_string(w, ' ')) >= 3)"


DICTIONARY = ", ".join([_phrases_sql("d1", "symptoms_vi", "canonical", "TRIỆU_CHỨNG", "alias"), _phrases_sql("d2", "rx_reference", "name", "THUỐC"), _phrases_sql("d3", "icd_reference", "name_vi", "CHẨN_ĐOÁN"), "dict AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"])
FOUND = (
    "whole AS (SELECT id, list(key ORDER BY pos) AS ks, list(start_pos ORDER BY pos) AS ss, list(end_pos ORDER BY pos) AS es FROM tok GROUP BY id), starts AS (SELECT id, ks, ss, es, unnest(ks) AS first, generate_subscripts(ks, 1) AS i FROM whole), "
    "found AS (SELECT r.id, r.ss[i] AS start_pos, r.es[i + d.n - 1] AS end_pos, d.entity_type, d.canonical, d.n FROM starts r JOIN dict d ON r.first = d.first WHERE array_to_string(r.ks[i:i + d.n - 1], ' ') = d.key)"
)
PRED_SQL = f"WITH {TOKENS}, {DICTIONARY}, {FOUND}, {GOLD} "


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "calibration").select(F.col("sample_no").alias("id"), "text")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return docs.tokens(_table(spark, sf, "calibration"), "sample_no", "text")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "calibration").select(F.col("sample_no").alias("id"), F.explode("entities").alias("e"))
    return d.select("id", "e.start_pos", "e.end_pos", "e.entity_type", "e.text")


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("symptoms_vi", "canonical", "TRIỆU_CHỨNG", "alias"), ("rx_reference", "name", "THUỐC", None), ("icd_reference", "name_vi", "CHẨN_ĐOÁN", None)]
    tables = [extract.phrase_table(_table(spark, sf, t), c, k, alias=a) for t, c, k, a in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return extract.dictionary_spans(_table(spark, sf, "calibration"), "sample_no", "text", _dictionary(spark, sf))


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {KEY.format('text')} AS norm_key, {FOLD.format(KEY.format('text'))} AS fold_key FROM documents")
def norm_lookup_key(spark: SparkSession, sf: str) -> DataFrame:
    key = tx.lookup_key(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", key.alias("norm_key"), tx.fold(key).alias("fold_key"))


@query("SELECT lang, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL GROUP BY lang")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").filter("text is not null").select("lang", F.size(tx.words(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]') OR regexp_matches(lower(text), '(^| )(khong|benh|dau|kham|uong|thuoc)( |$)') THEN 'vi' WHEN regexp_matches(lower(text), '(^| )(the|and|was|with|of)( |$)') THEN 'en' ELSE 'unknown' END AS guess FROM documents WHERE text IS NOT NULL")
def language_guess(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    vi = low.rlike("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]") | low.rlike("(^| )(khong|benh|dau|kham|uong|thuoc)( |$)")
    guess = F.when(vi, "vi").when(low.rlike("(^| )(the|and|was|with|of)( |$)"), "en").otherwise("unknown")
    return _table(spark, sf, "documents").filter("text is not null").select("doc_id", guess.alias("guess"))


_LINES = "parts AS (SELECT doc_id AS id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(1) || chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(1) || chr(10)), chr(13), chr(10)), chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), lined AS (SELECT id, CAST(line_no AS INTEGER) AS line_no, rtrim(line, chr(1)) AS line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_pos FROM parts)"


@query(f"WITH {_LINES} SELECT id, line_no, start_pos, CAST(start_pos + length(line) AS INTEGER) AS end_pos, CASE WHEN regexp_matches(line, '^\\s*[-*•]\\s+') THEN 1 WHEN regexp_matches(line, '^\\s*\\d+[.)]\\s+') THEN 2 WHEN regexp_matches(line, '^\\s*[a-zA-Z][.)]\\s+') THEN 3 END AS bullet FROM lined")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    d = docs.lines(_table(spark, sf, "documents"), "doc_id", "text")
    return d.select("id", "line_no", "start_pos", "end_pos", docs.bullet_level(F.col("line")).alias("bullet"))


_LABEL = "CASE " + " ".join(f"WHEN regexp_matches({FOLD.format('lower(line)')}, '^[ -]*(?:{p}):') THEN '{n}'" for n, p in HEADINGS) + " END"


@query(f"WITH {_LINES}, l AS (SELECT id, line_no, {_LABEL} AS label FROM lined) SELECT id, line_no, last_value(label IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l")
def section_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    lined = docs.lines(_table(spark, sf, "documents"), "doc_id", "text")
    return docs.sections(lined, [(n, f"^[ -]*(?:{p}):") for n, p in HEADINGS]).select("id", "line_no", "section")


@query(f"WITH {TOKENS}, n AS (SELECT id, count(*) AS n FROM tok GROUP BY id), w AS (SELECT id, n, unnest(range(0, greatest(1, CAST(ceil((n - 16) / 48.0) AS BIGINT)))) AS window_no FROM n), b AS (SELECT id, window_no, window_no * 48 AS first_token, least(window_no * 48 + 64, n) - 1 AS last_token FROM w) SELECT b.id, CAST(window_no AS INTEGER) AS window_no, CAST(first_token AS INTEGER) AS first_token, CAST(last_token AS INTEGER) AS last_token, f.start_pos, l.end_pos FROM b JOIN tok f ON f.id = b.id AND f.pos = first_token JOIN tok l ON l.id = b.id AND l.pos = last_token")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    return docs.token_windows(_table(spark, sf, "calibration"), "sample_no", "text", 64, 16)


_ENDS = "regexp_extract(left(rest, 500), '^(.*[.!?;:])', 1)"
_BLANK = "regexp_extract(left(rest, 500), '^(.*)\\s', 1)"
CHUNKS = f"{_LINES}, trimmed AS (SELECT id, line_no, start_pos + length(line) - length(ltrim(line, _ws)) AS at0, trim(line, _ws) AS rest FROM lined, (SELECT ' ' || chr(9) || chr(160) || chr(12) || chr(11) AS _ws) WHERE trim(line, _ws) <> ''), "
CHUNKS += f"cuts AS (SELECT id, line_no, at0, rest, 0 AS k, CASE WHEN length(rest) <= 500 THEN length(rest) WHEN length({_ENDS}) >= 200 THEN length({_ENDS}) WHEN length({_BLANK}) >= 200 THEN length({_BLANK}) ELSE 500 END AS n FROM trimmed UNION ALL "
CHUNKS += f"SELECT id, line_no, at0, rest, k, CASE WHEN length(rest) <= 500 THEN length(rest) WHEN length({_ENDS}) >= 200 THEN length({_ENDS}) WHEN length({_BLANK}) >= 200 THEN length({_BLANK}) ELSE 500 END FROM (SELECT id, line_no, at0 + n + (length(rest) - n - length(ltrim(substring(rest, n + 1)))) AS at0, ltrim(substring(rest, n + 1)) AS rest, k + 1 AS k FROM cuts WHERE n < length(rest)) WHERE rest <> ''), "
CHUNKS += "chunk AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY line_no, k) - 1 AS INTEGER) AS chunk_no, line_no, CAST(at0 AS INTEGER) AS start_pos, CAST(at0 + length(rtrim(left(rest, n))) AS INTEGER) AS end_pos, rtrim(left(rest, n)) AS chunk FROM cuts)"


@query(f"WITH RECURSIVE {CHUNKS} SELECT id, chunk_no, line_no, start_pos, end_pos FROM chunk")
def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    return docs.chunks(_table(spark, sf, "documents"), "doc_id", "text", 500).drop("chunk")


# --- extraction ------------------------------------------------------------------------------------------------------


@query(PRED_SQL + "SELECT id, start_pos, end_pos, entity_type, canonical, CAST(n AS INTEGER) AS n FROM found")
def dictionary_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)


_AFTER = FOLD.format("lower(substring(c.text, f.end_pos + 1, {}))")


@query(PRED_SQL + f", t AS (SELECT f.*, regexp_extract({_AFTER.format(80)}, '{extract.DOSE_TAIL}') AS tail FROM found f JOIN calibration c ON c.sample_no = f.id WHERE f.entity_type = 'THUỐC') SELECT id, start_pos, CAST(end_pos + length(tail) AS INTEGER) AS end_pos, canonical, tail FROM t")
def drug_spans(spark: SparkSession, sf: str) -> DataFrame:
    d = _found(spark, sf).filter("entity_type = 'THUỐC'")
    return extract.with_tail(d, _texts(spark, sf)).select("id", "start_pos", "end_pos", "canonical", "tail")


_TESTS = "tests AS (SELECT DISTINCT id, start_pos, end_pos FROM gold_spans WHERE entity_type = 'TÊN_XÉT_NGHIỆM')"


@query(f"WITH {GOLD}, {_TESTS} SELECT f.id, f.start_pos, f.end_pos, regexp_extract({_AFTER.format(60)}, '{extract.VALUE}', 1) AS value, regexp_extract({_AFTER.format(60)}, '{extract.VALUE}', 2) AS unit FROM tests f JOIN calibration c ON c.sample_no = f.id")
def lab_value_pairs(spark: SparkSession, sf: str) -> DataFrame:
    tests = _gold(spark, sf).filter("entity_type = 'TÊN_XÉT_NGHIỆM'").select("id", "start_pos", "end_pos").distinct()
    return extract.paired_values(tests, _texts(spark, sf))


@query(f"WITH k AS (SELECT DISTINCT {_WORDS.format('name')}[1] AS first, array_to_string({_WORDS.format('name')}, ' ') AS key FROM (SELECT name_vi AS name FROM icd_reference UNION ALL SELECT name FROM rx_reference)), r AS (SELECT first, row_number() OVER (PARTITION BY first ORDER BY length(key) DESC, key) AS rank, key FROM k) SELECT first, CAST(rank AS INTEGER) AS rank, key FROM r WHERE rank <= 250")
def first_token_index(spark: SparkSession, sf: str) -> DataFrame:
    names = _table(spark, sf, "icd_reference").select(F.col("name_vi").alias("name")).union(_table(spark, sf, "rx_reference").select("name"))
    return extract.first_token_index(names, "name", 250)


# --- resolution ------------------------------------------------------------------------------------------------------

_SCORED = PRED_SQL + ", scored AS (SELECT id, start_pos, end_pos, entity_type, n + 0.0 AS score FROM found UNION ALL SELECT id, start_pos, end_pos, entity_type, 0.5 AS score FROM gold_spans) "


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["id", "start_pos", "end_pos", "entity_type"]
    return _found(spark, sf).select(*columns, F.col("n").cast("double").alias("score")).unionByName(_gold(spark, sf).select(*columns, F.lit(0.5).alias("score")))


_PRIORITY = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 99 END"


@query(_SCORED + f", r AS (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos ORDER BY {_PRIORITY}, score DESC, entity_type) AS r FROM scored) SELECT id, start_pos, end_pos, entity_type, CAST(score AS DOUBLE) AS score FROM r WHERE r = 1")
def exact_span_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return spans.best_per_span(_scored(spark, sf), PRIORITY)


@query(_SCORED + "SELECT id, start_pos, end_pos, string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) AS types FROM scored GROUP BY id, start_pos, end_pos HAVING count(DISTINCT entity_type) > 1")
def type_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return spans.type_conflicts(_scored(spark, sf))


@query(PRED_SQL + "SELECT a.entity_type AS found_type, b.entity_type AS gold_type, count(*) AS n_pairs, CAST(sum(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) AS BIGINT) AS n_chars FROM found a JOIN gold_spans b ON a.id = b.id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos GROUP BY 1, 2")
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spans.overlapping_pairs(_found(spark, sf), _gold(spark, sf))
    return pairs.groupBy(F.col("a.entity_type").alias("found_type"), F.col("b.entity_type").alias("gold_type")).agg(F.count("*").alias("n_pairs"), F.sum(spans.overlap_length("a", "b")).cast("long").alias("n_chars"))


_IOU = "round((least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / ((a.end_pos - a.start_pos) + (b.end_pos - b.start_pos) - (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)))::DOUBLE, 6)"


@query(PRED_SQL + f", p AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM found), j AS (SELECT a.*, b.start_pos AS gold_start, b.end_pos AS gold_end, b.entity_type AS gold_type, {_IOU} AS iou FROM p a JOIN gold_spans b ON a.id = b.id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos), r AS (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos, entity_type ORDER BY iou DESC, gold_start, gold_end, gold_type) AS r FROM j) SELECT p.*, coalesce(r.gold_start, -1) AS gold_start, coalesce(r.gold_end, -1) AS gold_end, coalesce(r.gold_type, '') AS gold_type, coalesce(r.iou, 0) AS iou FROM p LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (id, start_pos, end_pos, entity_type)")
def nearest_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return spans.nearest_overlap(_found(spark, sf), _gold(spark, sf))


@query(PRED_SQL + f", p AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM found), j AS (SELECT a.*, b.start_pos AS anchor_start, b.end_pos AS anchor_end, {_IOU} AS iou FROM p a JOIN gold_spans b ON a.id = b.id AND a.entity_type = b.entity_type AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND ((a.start_pos <= b.start_pos AND a.end_pos >= b.end_pos) OR (b.start_pos <= a.start_pos AND b.end_pos >= a.end_pos)) AND (a.start_pos <> b.start_pos OR a.end_pos <> b.end_pos)), r AS (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos, entity_type ORDER BY iou DESC, anchor_start, anchor_end) AS r FROM j) SELECT id, start_pos, end_pos, entity_type, anchor_start, anchor_end, iou FROM r WHERE r = 1")
def structured_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return spans.structured_anchors(_found(spark, sf).select("id", "start_pos", "end_pos", "entity_type").distinct(), _gold(spark, sf))


_FLAT = "list_sort(list_distinct(flatten(list(coalesce({}, []::VARCHAR[])))))"


@query(f"SELECT file_id, span[1] AS start_pos, span[2] AS end_pos, entity_type, array_to_string({_FLAT.format('assertions')}, '|') AS assertions, array_to_string({_FLAT.format('candidates')}, '|') AS candidates, count(*) AS n_records FROM gold GROUP BY 1, 2, 3, 4")
def merge_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "gold").select(F.col("file_id").alias("id"), F.get("span", F.lit(0)).alias("start_pos"), F.get("span", F.lit(1)).alias("end_pos"), "entity_type", "assertions", "candidates")
    m = spans.merge_duplicates(d)
    return m.select(F.col("id").alias("file_id"), "start_pos", "end_pos", "entity_type", F.array_join("assertions", "|").alias("assertions"), F.array_join("candidates", "|").alias("candidates"), "n_records")


@query()
def complete_link_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return spans.complete_link_clusters(_scored(spark, sf))


# --- matching and metrics --------------------------------------------------------------------------------------------

_MATCH = PRED_SQL + ", p AS (SELECT id, start_pos, end_pos, entity_type, count(*) AS np FROM found GROUP BY ALL), g AS (SELECT id, start_pos, end_pos, entity_type, count(*) AS ng FROM gold_spans GROUP BY ALL), m AS (SELECT id, start_pos, end_pos, entity_type, least(coalesce(np, 0), coalesce(ng, 0)) AS tp, coalesce(np, 0) - least(coalesce(np, 0), coalesce(ng, 0)) AS fp, coalesce(ng, 0) - least(coalesce(np, 0), coalesce(ng, 0)) AS fn FROM p FULL JOIN g USING (id, start_pos, end_pos, entity_type)) "
_PRF = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 0 ELSE sum(tp) / (sum(tp) + sum(fp))::DOUBLE END, 6) AS precision, round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(tp) / (sum(tp) + sum(fn))::DOUBLE END, 6) AS recall, round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0 ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE END, 6)::DOUBLE AS f1"


@query(_MATCH + f"SELECT 'all' AS scope, {_PRF} FROM m")
def exact_match_prf(spark: SparkSession, sf: str) -> DataFrame:
    return spans.prf(spans.exact_matches(_found(spark, sf), _gold(spark, sf)).withColumn("scope", F.lit("all")), ["scope"])


@query(_MATCH + f"SELECT entity_type, {_PRF} FROM m GROUP BY entity_type")
def prf_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return spans.prf(spans.exact_matches(_found(spark, sf), _gold(spark, sf)), ["entity_type"])


@query(PRED_SQL + "SELECT g.entity_type AS gold_type, f.entity_type AS found_type, count(*) AS n FROM (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM gold_spans) g JOIN (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM found) f USING (id, start_pos, end_pos) GROUP BY 1, 2")
def type_confusion(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["id", "start_pos", "end_pos"]
    g = _gold(spark, sf).select(*columns, F.col("entity_type").alias("gold_type")).distinct()
    f = _found(spark, sf).select(*columns, F.col("entity_type").alias("found_type")).distinct()
    return g.join(f, columns).groupBy("gold_type", "found_type").agg(F.count("*").alias("n"))


@query(PRED_SQL + ", p AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM found), g AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM gold_spans) SELECT a.entity_type, CASE WHEN a.start_pos = b.start_pos AND a.end_pos = b.end_pos THEN 'exact' WHEN a.end_pos = b.end_pos THEN 'left' WHEN a.start_pos = b.start_pos THEN 'right' ELSE 'both' END AS kind, count(*) AS n FROM p a JOIN g b ON a.id = b.id AND a.entity_type = b.entity_type AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos GROUP BY 1, 2")
def boundary_errors(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["id", "start_pos", "end_pos", "entity_type"]
    pairs = spans.overlapping_pairs(_found(spark, sf).select(columns).distinct(), _gold(spark, sf).select(columns).distinct()).filter("a.entity_type = b.entity_type")
    kind = spans.boundary_kind(F.col("a.start_pos"), F.col("a.end_pos"), F.col("b.start_pos"), F.col("b.end_pos"))
    return pairs.select(F.col("a.entity_type").alias("entity_type"), kind.alias("kind")).groupBy("entity_type", "kind").agg(F.count("*").alias("n"))


_REPEATS = "firsts AS (SELECT file_id, rec_no, min(record_id) AS record_id FROM gold GROUP BY 1, 2), pairs AS (SELECT a.assertions AS l, b.assertions AS r, a.candidates AS lc, b.candidates AS rc, b.entity_type FROM firsts f JOIN gold a ON a.record_id = f.record_id JOIN gold b ON b.file_id = f.file_id AND b.rec_no = f.rec_no AND b.record_id <> f.record_id)"


def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    g = _table(spark, sf, "gold")
    firsts = g.groupBy("file_id", "rec_no").agg(F.min("record_id").alias("first_id"))
    later = g.join(firsts, ["file_id", "rec_no"]).filter("record_id != first_id").select("first_id", F.col("assertions").alias("r"), F.col("candidates").alias("rc"), "entity_type")
    return later.join(g.select(F.col("record_id").alias("first_id"), F.col("assertions").alias("l"), F.col("candidates").alias("lc")), "first_id")


@query(f"WITH {_REPEATS}, x AS (SELECT label, list_contains(coalesce(l, []), label) AS x, list_contains(coalesce(r, []), label) AS y FROM pairs, (SELECT unnest(['isNegated', 'isFamily', 'isHistorical']) AS label)) SELECT label, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x AND y) AS fp, count(*) FILTER (x AND NOT y) AS fn FROM x GROUP BY label")
def assertion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return audit.attribute_agreement(_repeats(spark, sf), "l", "r", audit.ASSERTIONS)


@query(f"WITH {_REPEATS}, s AS (SELECT entity_type, list_distinct(coalesce(lc, [])) AS x, list_distinct(coalesce(rc, [])) AS y FROM pairs) SELECT entity_type, count(*) AS n_pairs, round(avg(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END), 6) AS mean_jaccard FROM s GROUP BY entity_type")
def candidate_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _repeats(spark, sf).groupBy("entity_type").agg(F.count("*").alias("n_pairs"), F.round(F.avg(tx.jaccard(F.col("lc"), F.col("rc"))), 6).alias("mean_jaccard"))


# --- terminology and retrieval ---------------------------------------------------------------------------------------


def _alias_sql(name: str, source: str, code: str, columns: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT {code} AS code, {c} AS alias, '{c}' AS source FROM {source}" for c in columns)
    return f"{name} AS (SELECT code, min(alias) AS alias, source, norm_key, min(fold_key) AS fold_key FROM (SELECT code, alias, source, {KEY.format('alias')} AS norm_key, {FOLD.format(KEY.format('alias'))} AS fold_key FROM ({union}) WHERE alias IS NOT NULL AND trim(alias) <> '') GROUP BY code, source, norm_key)"


_ICD = _alias_sql("icd", "icd_reference", "code", ["name_vi", "name_en"])


def _icd(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.alias_table(_table(spark, sf, "icd_reference"), "code", ["name_vi", "name_en"])


@query(f"WITH {_ICD} SELECT * FROM icd")
def icd_alias_table(spark: SparkSession, sf: str) -> DataFrame:
    return _icd(spark, sf)


@query(f"WITH {_ICD}, m AS (SELECT DISTINCT canonical_hint AS mention FROM diagnosis_aliases WHERE canonical_hint IS NOT NULL), k AS (SELECT mention, {KEY.format('mention')} AS norm_key, {FOLD.format(KEY.format('mention'))} AS fold_key FROM m) SELECT mention, code, max(x) AS match FROM (SELECT mention, code, 1.0::DOUBLE AS x FROM k JOIN icd USING (norm_key) UNION ALL SELECT mention, code, 0.9::DOUBLE FROM k JOIN icd USING (fold_key)) GROUP BY mention, code")
def exact_alias_union(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.exact_alias(_table(spark, sf, "diagnosis_aliases"), "canonical_hint", _icd(spark, sf))


_BM25 = f"q AS (SELECT DISTINCT alias_id AS query_id, unnest({_WORDS.format('canonical_hint')}) AS term FROM diagnosis_aliases), dt AS (SELECT code, unnest({_WORDS.format('name_vi')}) AS term, len({_WORDS.format('name_vi')}) AS ln FROM icd_reference), p AS (SELECT code, term, count(*) AS tf, max(ln) AS ln FROM dt GROUP BY 1, 2), st AS (SELECT count(*) AS n, avg(ln) AS al FROM (SELECT DISTINCT code, ln FROM p)), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT query_id, code, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * p.ln / al))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY 1, 2)"


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    q = retrieval.postings(_table(spark, sf, "diagnosis_aliases"), "alias_id", retrieval.word_terms(F.col("canonical_hint")))
    d = retrieval.postings(_table(spark, sf, "icd_reference"), "code", retrieval.word_terms(F.col("name_vi")))
    return retrieval.bm25_top(q, d, k)


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rank FROM s) SELECT query_id, code, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 3)


def _grams_sql(column: str) -> str:
    return f"flatten(list_transform({_WORDS.format(column)}, lambda w: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(1, length(w) + 2 - n + 1) + 1), lambda i: substring(' ' || w || ' ', i, n))))))"


@query(f"WITH qt AS (SELECT alias_id AS id, unnest({_grams_sql('alias')}) AS term FROM drug_aliases WHERE alias IS NOT NULL), q AS (SELECT id, term, count(*) AS tf FROM qt GROUP BY 1, 2), dt AS (SELECT rxcui AS id, unnest({_grams_sql('name')}) AS term FROM rx_reference), d AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY 1, 2), n AS (SELECT count(DISTINCT id) AS n FROM d), f AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM d, n GROUP BY term), qv AS (SELECT id, term, tf * idf AS v FROM q JOIN f USING (term)), dv AS (SELECT id, term, tf * idf AS v FROM d JOIN f USING (term)), qn AS (SELECT id, sqrt(sum(v * v)) AS m FROM qv GROUP BY id), dn AS (SELECT id, sqrt(sum(v * v)) AS m FROM dv GROUP BY id), s AS (SELECT qv.id AS query_id, dv.id AS code, round(sum(qv.v / qn.m * (dv.v / dn.m)), 6) AS score FROM qv JOIN qn USING (id) JOIN dv ON dv.term = qv.term JOIN dn ON dn.id = dv.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rank FROM s) SELECT query_id, code, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = retrieval.postings(_table(spark, sf, "drug_aliases").filter("alias is not null"), "alias_id", retrieval.gram_terms(F.col("alias")))
    d = retrieval.postings(_table(spark, sf, "rx_reference"), "rxcui", retrieval.gram_terms(F.col("name")))
    return retrieval.tfidf_top(q, d, 3)


_JACCARD_SQL = "CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END"


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rank FROM s), c AS (SELECT query_id, r.code, score, max(score) OVER (PARTITION BY query_id) AS best, {_WORDS.format('a.canonical_hint')} AS x, {_WORDS.format('i.name_vi')} AS y FROM r JOIN diagnosis_aliases a ON a.alias_id = query_id JOIN icd_reference i ON i.code = r.code WHERE rank <= 5), e AS (SELECT query_id, code, round(0.7 * score / best + 0.3 * {_JACCARD_SQL}, 6) AS final FROM c), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, code DESC) AS rank, max(final) OVER (PARTITION BY query_id) AS top FROM e) SELECT query_id, code, final, CAST(rank AS INTEGER) AS rank FROM z WHERE top >= 0.6 AND (rank = 1 OR final >= top - 0.05 OR final >= 0.95) AND rank <= 3")
def rerank_select(spark: SparkSession, sf: str) -> DataFrame:
    c = _bm25(spark, sf, 5).drop("rank").join(_table(spark, sf, "diagnosis_aliases").select(F.col("alias_id").alias("query_id"), F.col("canonical_hint").alias("query")), "query_id")
    named = c.join(_table(spark, sf, "icd_reference").select("code", F.col("name_vi").alias("name")), "code")
    return retrieval.rerank_and_select(named, 0.6, 0.05, 0.95, 3)


# --- validation, audits, comparisons ---------------------------------------------------------------------------------

@query("WITH a AS (SELECT file_id, count(*) AS n_inputs FROM gold WHERE file_id IS NOT NULL GROUP BY 1), b AS (SELECT file_id, count(*) AS n_outputs FROM parsed_drug WHERE file_id IS NOT NULL GROUP BY 1) SELECT file_id, coalesce(n_inputs, 0) AS n_inputs, coalesce(n_outputs, 0) AS n_outputs, CASE WHEN coalesce(n_outputs, 0) = 0 THEN 'missing' WHEN coalesce(n_inputs, 0) = 0 THEN 'extra' ELSE 'both' END AS state FROM a FULL JOIN b USING (file_id)")
def directory_validation(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(_table(spark, sf, "gold"), _table(spark, sf, "parsed_drug"), "file_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id, span[1], span[2] ORDER BY record_id) AS r, min(record_id) OVER (PARTITION BY file_id, span[1], span[2]) AS first_id FROM gold) SELECT record_id, first_id FROM r WHERE r > 1")
def duplicate_span_warnings(spark: SparkSession, sf: str) -> DataFrame:
    g = _table(spark, sf, "gold").select("record_id", "file_id", F.get("span", F.lit(0)).alias("a"), F.get("span", F.lit(1)).alias("b"))
    first = g.groupBy("file_id", "a", "b").agg(F.min("record_id").alias("first_id"))
    keys = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("file_id", "a", "b")]
    return g.alias("g").join(first.alias("f"), keys[0] & keys[1] & keys[2]).filter("record_id != first_id").select("record_id", "first_id")


@query(f"WITH d AS (SELECT sample_no AS id, split, sha256({KEY.format('text')}) AS k FROM calibration WHERE text IS NOT NULL) SELECT id, split FROM d WHERE split <> 'train' AND k IN (SELECT k FROM d WHERE split = 'train')")
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exact_leakage(_table(spark, sf, "calibration"), "text", "sample_no", "split")


@query("SELECT file_id AS group_key, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) AS n_rows FROM calibration WHERE file_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.group_leakage(_table(spark, sf, "calibration"), "file_id", "split")


@query("SELECT split, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6)::DOUBLE AS median, round(quantile_cont(v, 0.95), 6)::DOUBLE AS p95 FROM (SELECT split, len(entities) AS v FROM calibration WHERE entities IS NOT NULL) GROUP BY split")
def split_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "calibration").select("split", F.when(F.col("entities").isNotNull(), F.size("entities")).alias("v"))
    return audit.distribution(d, ["split"], "v")


@query("WITH l AS (SELECT source, quantile_cont(n_chars, 0.95) AS p FROM documents WHERE n_chars IS NOT NULL GROUP BY source) SELECT doc_id AS id, d.source AS group_key, n_chars AS value FROM documents d JOIN l ON d.source = l.source WHERE n_chars > p")
def density_p95_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return audit.outliers(_table(spark, sf, "documents"), "doc_id", "source", "n_chars")


@query(f"WITH {TOKENS}, {GOLD}, j AS (SELECT t.id, t.pos, t.start_pos, t.end_pos, min(struct_pack(s := s.start_pos, y := s.entity_type)) AS m FROM tok t LEFT JOIN gold_spans s ON t.id = s.id AND t.start_pos >= s.start_pos AND t.end_pos <= s.end_pos GROUP BY 1, 2, 3, 4), l AS (SELECT id, pos, start_pos, end_pos, m.y AS y, CASE WHEN m.s IS NULL THEN 'O' WHEN m.s = start_pos THEN 'B' ELSE 'I' END AS b FROM j), k AS (SELECT *, CASE WHEN b <> 'O' AND (b = 'B' OR coalesce(lag(b) OVER w, 'O') = 'O' OR lag(y) OVER w IS DISTINCT FROM y) THEN 1 ELSE 0 END AS f FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)), i AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY pos) AS g FROM k) SELECT id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(y) AS entity_type, count(*) AS n_tokens FROM i WHERE b <> 'O' GROUP BY id, g")
def bio_islands(spark: SparkSession, sf: str) -> DataFrame:
    tok = _tokens(spark, sf).select("id", "pos", "start_pos", "end_pos")
    return audit.bio_spans(audit.bio_labels(tok, _gold(spark, sf)))


_RUN = "SELECT file_id, rec_no, entity_type || ':' || array_to_string(list_sort(coalesce(candidates, [])), ',') AS v, row_number() OVER (PARTITION BY file_id, rec_no ORDER BY record_id {}) AS r FROM gold"


@query(f"WITH a AS (SELECT * FROM ({_RUN.format('')}) WHERE r = 1), b AS (SELECT * FROM ({_RUN.format('DESC')}) WHERE r = 1) SELECT file_id, rec_no, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (file_id, rec_no)")
def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat("entity_type", F.lit(":"), F.array_join(F.array_sort(F.coalesce("candidates", F.array().cast("array<string>"))), ","))
    g = _table(spark, sf, "gold").select("file_id", "rec_no", "record_id", value.alias("v"))
    pick = lambda f: g.groupBy("file_id", "rec_no").agg(f("v", "record_id").alias("v"))
    return audit.run_diff(pick(F.min_by), pick(F.max_by), ["file_id", "rec_no"], "v")


@query("SELECT source, entity_type, count(*) AS n FROM (SELECT source, unnest(entities).entity_type AS entity_type FROM calibration) GROUP BY ROLLUP (source, entity_type)")
def source_type_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "calibration").select("source", F.explode("entities.entity_type").alias("entity_type"))
    return d.rollup("source", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT alias_id AS id, kind, noisy_text FROM (SELECT alias_id, 'accentless' AS kind, {FOLD.format('canonical')} AS noisy_text FROM symptoms_vi UNION ALL SELECT alias_id, 'lower', lower(canonical) FROM symptoms_vi UNION ALL SELECT alias_id, 'spaced', replace(canonical, ' ', '  ') FROM symptoms_vi UNION ALL SELECT alias_id, 'repeat_first', regexp_replace(canonical, '^([^ ]+) ', '\\1 \\1 ') FROM symptoms_vi) WHERE noisy_text IS NOT NULL")
def noise_augment(spark: SparkSession, sf: str) -> DataFrame:
    return audit.noisy(_table(spark, sf, "symptoms_vi"), "alias_id", "canonical")


# --- scores, parsing, proposals ----------------------------------------------------------------------------------------


@query(f"SELECT alias_id, round(CASE WHEN len(list_distinct(list_concat(u, v))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(u), list_distinct(v))) / len(list_distinct(list_concat(u, v)))::DOUBLE END, 6)::DOUBLE AS jaccard FROM (SELECT alias_id, coalesce({_WORDS.format('alias')}, []) AS u, coalesce({_WORDS.format('canonical')}, []) AS v FROM symptoms_vi)")
def jaccard_score(spark: SparkSession, sf: str) -> DataFrame:
    w = lambda c: tx.words(tx.fold(F.lower(c)))
    return _table(spark, sf, "symptoms_vi").select("alias_id", F.round(tx.jaccard(w("alias"), w("canonical")), 6).alias("jaccard"))


@query("SELECT p.mention_id, r.rxcui, p.strength_value, p.strength_unit FROM parsed_drug p JOIN rx_reference r ON lower(p.normalized_name) = lower(r.name) WHERE p.strength_value IS NOT NULL")
def ingredient_strength_join(spark: SparkSession, sf: str) -> DataFrame:
    p, r = _table(spark, sf, "parsed_drug").filter("strength_value is not null"), _table(spark, sf, "rx_reference")
    return p.join(r, F.lower("normalized_name") == F.lower("name")).select("mention_id", "rxcui", "strength_value", "strength_unit")


@query()
def record_json(spark: SparkSession, sf: str) -> DataFrame:
    return files.format_records(_gold(spark, sf).withColumns({"assertions": F.lit(None).cast("array<string>"), "candidates": F.lit(None).cast("array<string>")}))


# --- quantities ------------------------------------------------------------------------------------------------------


def _drugs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "parsed_drug").select("mention_id", "source", "raw", "strength_value", "strength_unit", "recorded_at")


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    done = units.common_units(_drugs(spark, sf), _table(spark, sf, "source_units"), "raw", "strength_value", "strength_unit", "source", "recorded_at")
    already = F.coalesce((F.col("strength_unit") == F.col("common_unit")) & (F.abs(F.col("strength_value") - F.col("amount")) < 1e-9 * (1 + F.col("amount"))), F.lit(False))
    return done.filter(F.col("amount").isNotNull() & ~already).select("mention_id", "common_unit", F.round(F.col("amount") * 1000).cast("long").alias("amount_milli"))


@query()
def p4_unit_shifts(spark: SparkSession, sf: str) -> DataFrame:
    read = units.cut_lineage(units.read_quantities(_drugs(spark, sf), _table(spark, sf, "source_units"), "raw", "strength_value", "strength_unit", "source"))
    history = read.filter("q_bare and q_factor is not null").select("source", F.to_date("recorded_at").alias("day"), F.col("q_number").alias("value"))
    days = units.unit_shifts(history)
    return days.groupBy("source", "segment", "shift").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


def queries() -> dict[str, Query]:
    from noteweave.plans import corpus, datasets, entities, evaluation, lexical, terms  # noqa: F401, PLC0415  # they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
