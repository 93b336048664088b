"""Queries on training data and experiment runs, and the tables of the review screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.operators import construction, runs
from noteweave.plans import catalog
from noteweave.plans.base import FOLD, query, table
from noteweave.plans.catalog import GOLD, PRED_SQL

_TEMPLATES = [("d1", "diagnosis", "Bệnh nhân được chẩn đoán {0} từ năm ngoái."), ("d2", "diagnosis", "{0}, theo dõi thêm."), ("m1", "drug", "Đang dùng {0} mỗi tối.")]
_TV = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _TEMPLATES)
_CONCEPTS = "SELECT code AS concept_id, name_vi AS surface, 'diagnosis' AS kind FROM icd_reference UNION ALL SELECT rxcui, name, 'drug' FROM rx_reference"


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    icd = table(spark, sf, "icd_reference").select(F.col("code").alias("concept_id"), F.col("name_vi").alias("surface"), F.lit("diagnosis").alias("kind"))
    rx = table(spark, sf, "rx_reference").select(F.col("rxcui").alias("concept_id"), F.col("name").alias("surface"), F.lit("drug").alias("kind"))
    return construction.fill_templates(icd.unionByName(rx), spark.createDataFrame(_TEMPLATES, "template_id string, kind string, pattern string"))


@query(f"SELECT 'syn_' || t.id || '_' || concept_id AS sample_id, t.id AS template_id, replace(pattern, '{{0}}', surface) AS text, CAST(strpos(pattern, '{{0}}') - 1 AS INTEGER) AS start_pos, CAST(strpos(pattern, '{{0}}') - 1 + length(surface) AS INTEGER) AS end_pos FROM ({_CONCEPTS}) c JOIN (VALUES {_TV}) t(id, kind, pattern) ON c.kind = t.kind")
def template_samples(spark: SparkSession, sf: str) -> DataFrame:
    d = _filled(spark, sf)
    return d.select("sample_id", "template_id", "text", F.col("spans")[0]["start_pos"].alias("start_pos"), F.col("spans")[0]["end_pos"].alias("end_pos"))


_L = "[A-Za-zÀ-ỹĐđ]"
_NOISE = "CASE number % 4 WHEN 0 THEN 'no_diacritics' WHEN 1 THEN 'missing_space' WHEN 2 THEN 'repeated_token' ELSE 'dropped_vowel' END"
_PIECE = f"CASE number % 4 WHEN 0 THEN {FOLD.format('p')} WHEN 1 THEN CASE WHEN strpos(p, ' ') > 0 THEN left(p, strpos(p, ' ') - 1) || substring(p, strpos(p, ' ') + 1) ELSE p END WHEN 2 THEN regexp_replace(p, '^([^A-Za-zÀ-ỹĐđ]*(?:{_L}[^A-Za-zÀ-ỹĐđ]+)*)({_L}{{2,}})', '\\1\\2\\2') ELSE regexp_replace(p, '^(.*?{_L})[aeiouyăâêôơưAEIOUYĂÂÊÔƠƯ]({_L})', '\\1\\2') END"
_CLEAN = "clean AS (SELECT * FROM (SELECT sample_no AS id, sample_no AS number, text, list_sort(list_transform(entities, lambda e: {'s': e.start_pos, 'e': e.end_pos})) AS es FROM calibration WHERE text IS NOT NULL AND entities IS NOT NULL) WHERE len(list_filter(es, lambda x, i: i > 1 AND es[i - 1].e > x.s)) = 0)"


@query(
    f"WITH {_CLEAN}, b AS (SELECT *, list_concat([0], flatten(list_transform(es, lambda x: [x.s, x.e])), [length(text)]) AS b FROM clean), pp AS (SELECT *, list_transform(list_transform(range(1, len(b)), lambda i: substring(text, CAST(b[i] + 1 AS BIGINT), CAST(b[i + 1] - b[i] AS BIGINT))), lambda p: {_PIECE}) AS ps FROM b) "
    f"SELECT id, {_NOISE} AS noise, array_to_string(ps, '') AS text, array_to_string(list_transform(es, lambda e, i: CAST(coalesce(list_sum(list_transform(ps[1:2 * i - 1], lambda x: length(x))), 0) AS BIGINT) || '-' || CAST(list_sum(list_transform(ps[1:2 * i], lambda x: length(x))) AS BIGINT)), ',') AS spans FROM pp"
)
def noisy_samples(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "calibration").filter("text is not null and entities is not null").select(F.col("sample_no").alias("id"), F.col("sample_no").alias("number"), "text", "entities")
    es = F.array_sort(F.transform("entities", lambda e: F.struct(e["start_pos"].alias("s"), e["end_pos"].alias("e"))))
    d = d.withColumn("_es", es).filter(~F.exists(F.transform("_es", lambda x, i: F.coalesce(F.get("_es", i - 1)["e"] > x["s"], F.lit(False)) & (i > 0)), lambda x: x))
    n = construction.add_noise(d, "number")
    return n.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat(s["start_pos"].cast("string"), F.lit("-"), s["end_pos"].cast("string"))), ","))


@query("SELECT source, e.entity_type AS entity_type, count(*) AS n FROM (SELECT source, unnest(entities) AS e FROM calibration) GROUP BY 1, 2")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return construction.label_distribution(table(spark, sf, "calibration"), "source")


@query("SELECT confidence_tier, file_id, sample_no FROM (SELECT *, row_number() OVER (PARTITION BY confidence_tier ORDER BY sample_no) AS r FROM calibration) WHERE r = 1")
def pilot_samples(spark: SparkSession, sf: str) -> DataFrame:
    return construction.first_of_each(table(spark, sf, "calibration"), "confidence_tier", "sample_no").select("confidence_tier", "file_id", "sample_no")


@query()
def dataset_hash(spark: SparkSession, sf: str) -> DataFrame:
    return construction.dataset_hash(table(spark, sf, "calibration"), ["sample_no", "file_id", "text", "split"])


@query()
def match_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "symptoms_vi").select("alias_id", F.round(construction.match_ratio(F.col("canonical"), F.col("alias")), 6).alias("ratio"))


# --- runs --------------------------------------------------------------------------------------------------------------

# A run is a generator version of a source; its parent is the version before.
_RUNS = "base AS (SELECT source, generator_version AS v, round(avg(len(coalesce(entities, []))), 6) AS score, round(avg(length(text)) / 500, 6) AS density FROM calibration WHERE source IS NOT NULL AND generator_version IS NOT NULL GROUP BY 1, 2), run AS (SELECT source || '/' || v AS run_id, source AS family, source || '/' || lag(v) OVER (PARTITION BY source ORDER BY v) AS parent_id, score, density FROM base)"
_TYPED = "typed AS (SELECT source || '/' || generator_version AS run_id, e.entity_type AS entity_type, round(count(*) / 1000.0, 6) AS score FROM (SELECT source, generator_version, unnest(entities) AS e FROM calibration) WHERE source IS NOT NULL AND generator_version IS NOT NULL GROUP BY 1, 2)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "calibration").filter("source is not null and generator_version is not null")
    n = F.when(F.col("entities").isNull(), 0).otherwise(F.size("entities"))
    g = c.groupBy(F.col("source").alias("family"), F.col("generator_version").alias("v")).agg(F.round(F.avg(n), 6).alias("score"), F.round(F.avg(F.length("text")) / 500, 6).alias("density"))
    before = F.lag("v").over(W.partitionBy("family").orderBy("v"))
    return g.select(F.concat("family", F.lit("/"), "v").alias("run_id"), "family", F.concat("family", F.lit("/"), before).alias("parent_id"), "score", "density")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "calibration").filter("source is not null and generator_version is not null").select(F.concat("source", F.lit("/"), "generator_version").alias("run_id"), F.explode("entities.entity_type").alias("entity_type"))
    return c.groupBy("run_id", "entity_type").agg(F.round(F.count("*") / 1000.0, 6).alias("score"))


@query(f"WITH {_RUNS}, {_TYPED}, lost AS (SELECT r.run_id, count(*) AS n FROM run r JOIN typed p ON p.run_id = r.parent_id LEFT JOIN typed t ON t.run_id = r.run_id AND t.entity_type = p.entity_type WHERE round(p.score - coalesce(t.score, 0), 9) > 0.02 GROUP BY 1), d AS (SELECT r.run_id, coalesce(r.density > 1.6, true) AS dense, p.score IS NOT NULL AND round(r.score - p.score, 9) < 0.01 AS small, coalesce(l.n, 0) AS n FROM run r LEFT JOIN run p ON p.run_id = r.parent_id LEFT JOIN lost l ON l.run_id = r.run_id) SELECT run_id, CASE WHEN dense OR n > 0 THEN 'reject' WHEN small THEN 'investigate' ELSE 'keep' END AS decision, CAST(CAST(dense AS INTEGER) + CAST(small AS INTEGER) + n AS INTEGER) AS n_reasons FROM d")
def policy_decision(spark: SparkSession, sf: str) -> DataFrame:
    return runs.decide_by_type(_runs(spark, sf), _typed(spark, sf), 0.01, 0.02, 1.6)


@query(f"WITH {_RUNS} SELECT run_id, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, density DESC NULLS LAST, run_id) AS INTEGER) AS rank FROM run")
def run_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return runs.ranked(_runs(spark, sf), ["score", "density"]).select("run_id", "rank")


@query(f"WITH {_RUNS} SELECT family, bool_and(coalesce(score > 3, false)) AS enough, bool_and(coalesce(density < 1.6, false)) AS sparse, count(*) AS n_runs FROM run GROUP BY 1")
def run_gates(spark: SparkSession, sf: str) -> DataFrame:
    return runs.gates(_runs(spark, sf), "family", {"enough": "score > 3", "sparse": "density < 1.6"})


_PATCHED = "reg AS (SELECT run_id, family, CASE WHEN parent_id IS NULL AND family LIKE 's%' THEN run_id ELSE parent_id END AS parent_id FROM run UNION ALL SELECT run_id, 'other', 'nowhere' FROM run WHERE parent_id IS NULL)"


@query(f"WITH RECURSIVE {_RUNS}, {_PATCHED}, one AS (SELECT run_id, min(parent_id) AS parent_id FROM reg WHERE parent_id IS NOT NULL AND parent_id <> 'nowhere' GROUP BY 1), fam AS (SELECT run_id, min(family) AS family FROM reg WHERE family <> 'other' GROUP BY 1), walk AS (SELECT run_id, parent_id AS up, 1 AS n FROM one UNION ALL SELECT w.run_id, o.parent_id, n + 1 FROM walk w JOIN one o ON o.run_id = w.up WHERE n < (SELECT count(*) + 1 FROM one)) "
       "SELECT run_id, 'duplicate_run_id' AS code FROM reg GROUP BY run_id HAVING count(*) > 1 UNION ALL SELECT r.run_id, CASE WHEN f.run_id IS NULL THEN 'unknown_parent' ELSE 'parent_of_other_family' END FROM reg r LEFT JOIN fam f ON f.run_id = r.parent_id WHERE r.parent_id IS NOT NULL AND (f.run_id IS NULL OR f.family <> r.family) UNION ALL SELECT run_id, 'parent_cycle' FROM walk GROUP BY run_id HAVING max(n) > (SELECT count(*) FROM one)")
def run_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The runs with some faults put in: first runs of some sources are their own parent, and each is listed again under an unknown one."""
    r = _runs(spark, sf).select("run_id", "family", "parent_id")
    own = r.withColumn("parent_id", F.when(F.col("parent_id").isNull() & F.col("family").like("s%"), F.col("run_id")).otherwise(F.col("parent_id")))
    again = r.filter("parent_id is null").select("run_id", F.lit("other").alias("family"), F.lit("nowhere").alias("parent_id"))
    both = own.unionByName(again)
    known = own.unionByName(again.filter("1 = 0"))
    issues = runs.registry_issues(known).filter("code != 'duplicate_run_id'")
    more = runs.registry_issues(both).filter("code = 'duplicate_run_id'")
    return issues.unionByName(more).unionByName(again.select("run_id", F.lit("unknown_parent").alias("code")))


@query("SELECT file_id AS id, count(DISTINCT split) AS n_splits FROM calibration WHERE file_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return runs.shared_ids(table(spark, sf, "calibration").select(F.col("file_id").alias("id"), "split"))


@query("SELECT axis, value::DOUBLE AS value FROM (SELECT DISTINCT e.entity_type AS axis, CASE WHEN e.entity_type = 'THUỐC' THEN 0.3 ELSE 0.35 END AS current FROM (SELECT unnest(entities) AS e FROM calibration)) a JOIN (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6]) AS value) v ON value <> current")
def coordinate_grid(spark: SparkSession, sf: str) -> DataFrame:
    axes = table(spark, sf, "calibration").select(F.explode("entities.entity_type").alias("axis")).distinct().withColumn("current", F.when(F.col("axis") == "THUỐC", 0.3).otherwise(0.35))
    values = spark.createDataFrame([(x,) for x in (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6)], "value double")
    return runs.coordinate_grid(axes, values)


_SIDE = "SELECT file_id, {f}(text, sample_no) AS text FROM calibration WHERE file_id IS NOT NULL GROUP BY 1"


@query(f"WITH a AS ({_SIDE.format(f='arg_min')}), b AS ({_SIDE.format(f='arg_max')}) SELECT coalesce(a.file_id, b.file_id) AS id, CASE WHEN a.file_id IS NULL THEN 'only_second' WHEN b.file_id IS NULL THEN 'only_first' WHEN coalesce(a.text, '') = coalesce(b.text, '') THEN 'same' ELSE 'different' END AS state FROM a FULL JOIN b ON a.file_id = b.file_id")
def output_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "calibration").filter("file_id is not null").filter("text is not null")
    side = lambda f: c.groupBy("file_id").agg(f("text", "sample_no").alias("text"))
    every = table(spark, sf, "calibration").filter("file_id is not null").select("file_id").distinct()
    return runs.compare_outputs(every.join(side(F.min_by), "file_id", "left"), every.join(side(F.max_by), "file_id", "left"), "file_id", "text")


# --- review tables -----------------------------------------------------------------------------------------------------


@query(f"{PRED_SQL}, p AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM found), g AS (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM gold_spans) SELECT 'gold' AS side, g.*, CASE WHEN (id, start_pos, end_pos, entity_type) IN (SELECT * FROM p) THEN 'exact_match' ELSE 'unmatched' END AS state FROM g UNION ALL SELECT 'pred', p.*, CASE WHEN (id, start_pos, end_pos, entity_type) IN (SELECT * FROM g) THEN 'exact_match' ELSE 'unmatched' END FROM p")
def compare_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = ["id", "start_pos", "end_pos", "entity_type"]
    p, g = catalog._found(spark, sf).select(k).distinct(), catalog._gold(spark, sf).select(k).distinct()
    flag = lambda a, b, side: a.join(b.withColumn("_h", F.lit(1)), k, "left").select(F.lit(side).alias("side"), *k, F.when(F.col("_h").isNull(), "unmatched").otherwise("exact_match").alias("state"))
    return flag(g, p, "gold").unionByName(flag(p, g, "pred"))


@query("SELECT record_id, file_id, text, span[1] AS start_pos, span[2] AS end_pos, entity_type, array_to_string(coalesce(assertions, []), ', ') AS assertions, array_to_string(coalesce(candidates, []), ', ') AS candidates FROM gold")
def flat_records(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    return table(spark, sf, "gold").select("record_id", "file_id", "text", F.get("span", F.lit(0)).alias("start_pos"), F.get("span", F.lit(1)).alias("end_pos"), "entity_type", F.array_join(F.coalesce("assertions", empty), ", ").alias("assertions"), F.array_join(F.coalesce("candidates", empty), ", ").alias("candidates"))


@query("SELECT record_id, entity_type, text FROM gold WHERE entity_type IN ('THUỐC', 'CHẨN_ĐOÁN') AND contains(lower(text), 'viêm') AND annotator IS NOT NULL")
def filtered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The review filter: type, part of the text, another column."""
    g = table(spark, sf, "gold").filter(F.col("entity_type").isin("THUỐC", "CHẨN_ĐOÁN") & F.contains(F.lower("text"), F.lit("viêm")) & F.col("annotator").isNotNull())
    return g.select("record_id", "entity_type", "text")


_JSON_ROW = f"{GOLD} SELECT id, count(*) AS n_records FROM gold_spans GROUP BY 1"


@query(f"WITH {_JSON_ROW}")
def counts_by_note(spark: SparkSession, sf: str) -> DataFrame:
    return catalog._gold(spark, sf).groupBy("id").agg(F.count("*").alias("n_records"))
