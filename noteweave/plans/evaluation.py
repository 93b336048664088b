"""Queries on matches, errors and scores: predictions are the dictionary's spans, the gold side is the annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.operators import scoring
from noteweave.plans import catalog
from noteweave.plans.base import SQUEEZE, query, table
from noteweave.plans.lexical import WER
from noteweave.session import cut_lineage

_SIDES = catalog.PRED_SQL.replace("WITH ", "", 1) + (
    ", pred AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type, canonical) - 1 AS INTEGER) AS no, start_pos, end_pos, entity_type, canonical FROM found)"
    ", goldn AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, entity_type, text) - 1 AS INTEGER) AS no, start_pos, end_pos, entity_type, text FROM gold_spans)"
)
_OV = "(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos))"
_LA, _LB = "(a.end_pos - a.start_pos)", "(b.end_pos - b.start_pos)"
_IOU, _SHARE = f"({_OV} / ({_LA} + {_LB} - {_OV})::DOUBLE)", f"({_OV} / least({_LA}, {_LB})::DOUBLE)"


def _over(a: str, b: str) -> str:
    return f"{a} a JOIN {b} b ON a.id = b.id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos"


def greedy_sql(pairs: str, order: str, out: str) -> str:
    """``out``: the rows of ``pairs`` (id, pred_no, gold_no, ...) that a greedy one-to-one choice keeps. Needs WITH RECURSIVE."""
    return (
        f"{out}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}, pred_no, gold_no) AS k FROM {pairs}), {out}_f AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS ps, CAST([] AS INTEGER[]) AS gs, false AS kept FROM (SELECT DISTINCT id FROM {out}_r) UNION ALL "
        f"SELECT f.id, r.k, CASE WHEN NOT list_contains(ps, pred_no) AND NOT list_contains(gs, gold_no) THEN list_append(ps, pred_no) ELSE ps END, CASE WHEN NOT list_contains(ps, pred_no) AND NOT list_contains(gs, gold_no) THEN list_append(gs, gold_no) ELSE gs END, NOT list_contains(ps, pred_no) AND NOT list_contains(gs, gold_no) FROM {out}_f f JOIN {out}_r r ON r.id = f.id AND r.k = f.k + 1), {out} AS (SELECT r.* FROM {out}_r r JOIN {out}_f f USING (id, k) WHERE f.kept)"
    )


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found, gold = catalog._found(spark, sf), catalog._gold(spark, sf)
    number = lambda last: (F.row_number().over(W.partitionBy("id").orderBy("start_pos", "end_pos", "entity_type", last)) - 1).cast("int").alias("no")
    p = found.select("id", number("canonical"), "start_pos", "end_pos", "entity_type", "canonical")
    return cut_lineage(p), cut_lineage(gold.select("id", number("text"), "start_pos", "end_pos", "entity_type", "text"))


_EXACT = "exact AS (SELECT p.id, p.no AS pred_no, g.no AS gold_no FROM (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos, entity_type ORDER BY no) AS n FROM pred) p JOIN (SELECT *, row_number() OVER (PARTITION BY id, start_pos, end_pos, entity_type ORDER BY no) AS n FROM goldn) g USING (id, start_pos, end_pos, entity_type, n))"
_REST = "up AS (SELECT * FROM pred WHERE (id, no) NOT IN (SELECT id, pred_no FROM exact)), ug AS (SELECT * FROM goldn WHERE (id, no) NOT IN (SELECT id, gold_no FROM exact))"
_RELAXED = f"near AS (SELECT a.id, a.no AS pred_no, b.no AS gold_no, {_IOU} AS iou, {_SHARE} AS share, abs({_LA} - {_LB}) AS gap FROM {_over('pred', 'goldn')} WHERE a.entity_type = b.entity_type AND ({_IOU} >= 0.5 OR {_SHARE} >= 0.8)), " + greedy_sql("near", "iou DESC, share DESC, gap", "relaxed")


@query(f"WITH {_SIDES}, {_EXACT} SELECT id, pred_no, gold_no FROM exact")
def exact_match_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.exact_pairs(*_sides(spark, sf))


@query(f"WITH RECURSIVE {_SIDES}, {_RELAXED} SELECT id, pred_no, gold_no, round(iou, 6) AS iou FROM relaxed")
def relaxed_match_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.relaxed_pairs(*_sides(spark, sf)).withColumn("iou", F.round("iou", 6))


_WRONG = (
    f"sm_p AS (SELECT a.id, a.no AS pred_no, b.no AS gold_no, {_IOU} AS iou, {_SHARE} AS share, CASE WHEN a.start_pos = b.start_pos AND a.end_pos <> b.end_pos THEN 'right_boundary_error' WHEN a.start_pos <> b.start_pos AND a.end_pos = b.end_pos THEN 'left_boundary_error' ELSE 'both_boundary_error' END AS subcategory FROM {_over('up', 'ug')} WHERE a.entity_type = b.entity_type AND ({_IOU} >= 0.5 OR {_SHARE} >= 0.8)), " + greedy_sql("sm_p", "iou DESC, share DESC", "sm")
    + f", tm_p AS (SELECT a.id, a.no AS pred_no, b.no AS gold_no, {_IOU} AS iou, {_SHARE} AS share, a.entity_type || '__vs__' || b.entity_type AS subcategory FROM {_over('up', 'ug')} WHERE a.entity_type <> b.entity_type AND ({_IOU} >= 0.5 OR {_SHARE} >= 0.8)), " + greedy_sql("tm_p", "iou DESC, share DESC", "tm")
    + ", wrong AS (SELECT id, pred_no, gold_no, 'span_mismatch' AS category, subcategory FROM sm UNION ALL SELECT id, pred_no, gold_no, 'type_mismatch', subcategory FROM tm)"
)


def _wrong(spark: SparkSession, sf: str) -> DataFrame:
    p, g = _sides(spark, sf)
    m = cut_lineage(scoring.exact_pairs(p, g))
    up, ug = scoring.unmatched(p, m, "pred_no"), scoring.unmatched(g, m, "gold_no")
    return scoring.mismatches(up, ug, True).unionByName(scoring.mismatches(up, ug, False))


@query(f"WITH RECURSIVE {_SIDES}, {_EXACT}, {_REST}, {_WRONG} SELECT * FROM wrong")
def mismatch_records(spark: SparkSession, sf: str) -> DataFrame:
    return _wrong(spark, sf)


@query(f"WITH RECURSIVE {_SIDES}, {_EXACT}, {_REST}, {_WRONG} SELECT category, subcategory, count(*) AS n FROM wrong GROUP BY 1, 2")
def error_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _wrong(spark, sf).groupBy("category", "subcategory").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_SIDES}, {_EXACT}, {_REST}, {_WRONG} SELECT category, id, pred_no, gold_no FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id, pred_no) AS r FROM wrong) WHERE r <= 50")
def error_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 errors of each category: a sample report."""
    w = W.partitionBy("category").orderBy("id", "pred_no")
    return _wrong(spark, sf).withColumn("_r", F.row_number().over(w)).filter("_r <= 50").select("category", "id", "pred_no", "gold_no")


_NEAR = lambda x, y: f"SELECT s.id, s.no, s.entity_type, coalesce(n.near_no, -1) AS near_no, round(coalesce(n.iou, 0), 6)::DOUBLE AS iou, round(coalesce(n.share, 0), 6)::DOUBLE AS share FROM {x} s LEFT JOIN (SELECT * FROM (SELECT a.id, a.no, b.no AS near_no, {_IOU} AS iou, {_SHARE} AS share, row_number() OVER (PARTITION BY a.id, a.no ORDER BY {_IOU} DESC, {_SHARE} DESC, {_OV} DESC, b.no) AS r FROM {_over(x, y)}) WHERE r = 1) n USING (id, no)"


@query(f"WITH {_SIDES}, {_EXACT}, {_REST} SELECT 'false_positive' AS category, * FROM ({_NEAR('up', 'goldn')}) UNION ALL SELECT 'false_negative', * FROM ({_NEAR('ug', 'pred')})")
def unmatched_records(spark: SparkSession, sf: str) -> DataFrame:
    p, g = _sides(spark, sf)
    m = cut_lineage(scoring.exact_pairs(p, g))
    c = ["id", "no", "entity_type", "near_no", F.round("iou", 6).alias("iou"), F.round("share", 6).alias("share")]
    one = scoring.nearest(scoring.unmatched(p, m, "pred_no"), g).select(F.lit("false_positive").alias("category"), *c)
    return one.unionByName(scoring.nearest(scoring.unmatched(g, m, "gold_no"), p).select(F.lit("false_negative").alias("category"), *c))


def _counts_sql(by: str, pairs: str, out: str) -> str:
    return f"{out} AS (SELECT {by}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT {by}, 0 AS tp, CASE WHEN (id, no) IN (SELECT id, pred_no FROM {pairs}) THEN 0 ELSE 1 END AS fp, 0 AS fn FROM pred UNION ALL SELECT {by}, CASE WHEN (id, no) IN (SELECT id, gold_no FROM {pairs}) THEN 1 ELSE 0 END, 0, CASE WHEN (id, no) IN (SELECT id, gold_no FROM {pairs}) THEN 0 ELSE 1 END FROM goldn) GROUP BY 1)"


def _rates_sql(t: str, p: str = "") -> str:
    return f"round(CASE WHEN {t}.tp + {t}.fp = 0 THEN 0 ELSE {t}.tp / ({t}.tp + {t}.fp)::DOUBLE END, 6)::DOUBLE AS {p}precision, round(CASE WHEN {t}.tp + {t}.fn = 0 THEN 0 ELSE {t}.tp / ({t}.tp + {t}.fn)::DOUBLE END, 6)::DOUBLE AS {p}recall, round(CASE WHEN 2 * {t}.tp + {t}.fp + {t}.fn = 0 THEN 0 ELSE 2.0 * {t}.tp / (2 * {t}.tp + {t}.fp + {t}.fn)::DOUBLE END, 6)::DOUBLE AS {p}f1"


def _both_counts(spark: SparkSession, sf: str, by: str) -> DataFrame:
    p, g = _sides(spark, sf)
    e = scoring.rates(scoring.side_counts(p, g, scoring.exact_pairs(p, g), [by]))
    r = scoring.side_counts(p, g, scoring.relaxed_pairs(p, g), [by])
    r = scoring.rates(r.toDF(by, *("relaxed_" + c for c in r.columns[1:])), "relaxed_")
    return e.join(r, by, "full")


for _by, _name in (("id", "per_file_metrics"), ("entity_type", "per_type_metrics")):

    def _metrics(spark: SparkSession, sf: str, by: str = _by) -> DataFrame:
        return _both_counts(spark, sf, by)

    _metrics.__name__ = _name
    query(f"WITH RECURSIVE {_SIDES}, {_EXACT}, {_RELAXED}, {_counts_sql(_by, 'exact', 'ec')}, {_counts_sql(_by, 'relaxed', 'rc')} SELECT {_by}, ec.tp, ec.fp, ec.fn, {_rates_sql('ec')}, rc.tp AS relaxed_tp, rc.fp AS relaxed_fp, rc.fn AS relaxed_fn, {_rates_sql('rc', 'relaxed_')} FROM ec FULL JOIN rc USING ({_by})")(_metrics)


_DENSE = ", ".join(f"count(*) FILTER (WHERE f.entity_type = '{t}') AS to_{i}" for i, t in enumerate(scoring.TYPES))


@query(f"WITH {_SIDES} SELECT g.entity_type AS gold_type, {_DENSE} FROM (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM goldn) g JOIN (SELECT DISTINCT id, start_pos, end_pos, entity_type FROM pred) f USING (id, start_pos, end_pos) GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    c = ["id", "start_pos", "end_pos"]
    g = catalog._gold(spark, sf).select(*c, F.col("entity_type").alias("gold_type")).distinct()
    f = catalog._found(spark, sf).select(*c, "entity_type").distinct()
    return g.join(f, c).groupBy("gold_type").agg(*(F.count_if(F.col("entity_type") == t).alias(f"to_{i}") for i, t in enumerate(scoring.TYPES)))


@query(f"WITH {_SIDES}, x AS (SELECT a.id, a.start_pos, a.end_pos, max({_LA} - {_LB}) AS extra FROM {_over('pred', 'goldn')} WHERE a.entity_type = b.entity_type AND a.start_pos <= b.start_pos AND a.end_pos >= b.end_pos GROUP BY 1, 2, 3) SELECT * FROM x WHERE extra > 0 ORDER BY extra DESC, id, start_pos, end_pos LIMIT 20")
def longest_extensions(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 predictions that reach farthest beyond an annotation inside them: a top-k report."""
    p, g = _sides(spark, sf)
    from noteweave.operators.spans import overlapping_pairs

    x = overlapping_pairs(p, g).filter("a.entity_type = b.entity_type and a.start_pos <= b.start_pos and a.end_pos >= b.end_pos")
    x = x.groupBy("a.id", "a.start_pos", "a.end_pos").agg(F.max((F.col("a.end_pos") - F.col("a.start_pos")) - (F.col("b.end_pos") - F.col("b.start_pos"))).alias("extra"))
    return x.filter("extra > 0").orderBy(F.col("extra").desc(), "id", "start_pos", "end_pos").limit(20)


@query("SELECT record_id, entity_type, text FROM gold WHERE entity_type IN ('CHẨN_ĐOÁN', 'THUỐC') AND len(coalesce(candidates, [])) = 0")
def no_candidate_records(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold").filter(F.col("entity_type").isin("CHẨN_ĐOÁN", "THUỐC") & (F.size(F.coalesce("candidates", F.array().cast("array<string>"))) == 0))
    return g.select("record_id", "entity_type", "text")


# --- attributes of repeated annotations --------------------------------------------------------------------------------

_PAIRS = catalog._REPEATS
_EQ = "list_sort(list_distinct(coalesce(l, []))) = list_sort(list_distinct(coalesce(r, [])))"


@query(f"WITH {_PAIRS} SELECT count(*) AS n, count(*) FILTER (WHERE {_EQ}) AS n_equal, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (WHERE {_EQ}) / count(*)::DOUBLE END, 6)::DOUBLE AS rate FROM pairs WHERE entity_type IN ('THUỐC', 'CHẨN_ĐOÁN', 'TRIỆU_CHỨNG')")
def assertion_set_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.set_agreement(catalog._repeats(spark, sf).filter(F.col("entity_type").isin("THUỐC", "CHẨN_ĐOÁN", "TRIỆU_CHỨNG")), "l", "r")


_GP = "SELECT entity_type, coalesce(lc, []) AS g, coalesce(rc, []) AS p FROM pairs"
_HIT, _SAME = "len(list_intersect(g, p)) > 0", "list_sort(list_distinct(g)) = list_sort(list_distinct(p))"


@query(f"WITH {_PAIRS}, d AS ({_GP}), a AS (SELECT entity_type, count(*) FILTER (WHERE len(g) > 0) AS total_evaluable, count(*) FILTER (WHERE len(g) > 0 AND {_HIT}) AS hit_count, count(*) FILTER (WHERE len(g) > 0 AND {_SAME}) AS exact_set_match_count, count(*) FILTER (WHERE len(g) = 0) AS skipped_empty_gold FROM d GROUP BY 1) SELECT *, round(CASE WHEN total_evaluable = 0 THEN 0 ELSE hit_count / total_evaluable::DOUBLE END, 6)::DOUBLE AS hit_rate, round(CASE WHEN total_evaluable = 0 THEN 0 ELSE exact_set_match_count / total_evaluable::DOUBLE END, 6)::DOUBLE AS exact_set_match_rate FROM a")
def candidate_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.candidate_agreement(catalog._repeats(spark, sf), "entity_type", "lc", "rc")


@query(f"WITH {_PAIRS}, d AS ({_GP}) SELECT entity_type, CASE WHEN {_SAME} THEN 'exact_candidate_match' WHEN len(p) = 0 THEN 'missing_candidate' WHEN len(g) = 0 THEN 'extra_candidate_when_gold_empty' WHEN {_HIT} THEN 'partial_candidate' ELSE 'wrong_candidate' END AS category, count(*) AS n FROM d GROUP BY 1, 2")
def candidate_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    d = catalog._repeats(spark, sf).select("entity_type", scoring.candidate_category(F.coalesce("lc", empty), F.coalesce("rc", empty)).alias("category"))
    return d.groupBy("entity_type", "category").agg(F.count("*").alias("n"))


# --- scores ------------------------------------------------------------------------------------------------------------

_CONCEPTS = f"cp AS (SELECT a.id, a.no AS pred_no, b.no AS gold_no, {_OV} AS shared FROM {_over('pred', 'goldn')} WHERE a.entity_type = b.entity_type), " + greedy_sql("cp", "shared DESC", "cm")
_ATTR = lambda t, f, types: f"(SELECT id, list(DISTINCT concept || chr(1) || v) AS s FROM (SELECT id, concept, unnest({f}) AS v FROM {t} WHERE entity_type IN ({types})) GROUP BY 1)"
_ABLE, _LINK = "'TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC'", "'CHẨN_ĐOÁN', 'THUỐC'"
_JAC = lambda a, b: f"round(CASE WHEN len(coalesce({a}, [])) + len(coalesce({b}, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce({a}, []), coalesce({b}, []))) / len(list_distinct(list_concat(coalesce({a}, []), coalesce({b}, []))))::DOUBLE END, 6)::DOUBLE"
_SCORES = (
    f"{_SIDES}, {_CONCEPTS}, "
    "full_p AS (SELECT p.*, substring(c.text, p.start_pos + 1, p.end_pos - p.start_pos) AS text, ['x' || CAST(p.no % 3 AS VARCHAR)] AS assertions, [p.canonical] AS candidates, coalesce('g' || m.gold_no, 'p' || p.no) AS concept FROM pred p JOIN calibration c ON c.sample_no = p.id LEFT JOIN cm m ON m.id = p.id AND m.pred_no = p.no), "
    "full_g AS (SELECT *, ['x' || CAST(no % 3 AS VARCHAR)] AS assertions, [lower(text)] AS candidates, 'g' || no AS concept FROM goldn), "
    "ids AS (SELECT DISTINCT sample_no AS id FROM calibration WHERE text IS NOT NULL), tx AS (SELECT i.id, coalesce(a.t, '') AS gold, coalesce(b.t, '') AS pred, coalesce(a.n, 0) AS n_gold, coalesce(b.n, 0) AS n_pred FROM ids i LEFT JOIN (SELECT id, trim(string_agg(text, ' ' ORDER BY start_pos, end_pos, no)) AS t, count(*) AS n FROM full_g GROUP BY 1) a USING (id) LEFT JOIN (SELECT id, trim(string_agg(text, ' ' ORDER BY start_pos, end_pos, no)) AS t, count(*) AS n FROM full_p GROUP BY 1) b USING (id)), "
    f"pairs AS (SELECT id, list_filter(string_split({SQUEEZE.format('gold')}, ' '), lambda t: t <> '') AS r, list_filter(string_split({SQUEEZE.format('pred')}, ' '), lambda t: t <> '') AS h FROM tx), {WER}, "
    "ws AS (SELECT id, d[len(h) + 1] / len(r)::DOUBLE AS w FROM dp WHERE i = len(r) UNION ALL SELECT id, CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END FROM pairs WHERE len(r) = 0), "
    f"ts AS (SELECT t.id, round(greatest(0.0, least(1.0, 1.0 - w)), 6)::DOUBLE AS text, {_JAC('pa.s', 'ga.s')} AS assertions, {_JAC('pc.s', 'gc.s')} AS candidates, CAST(coalesce(cw.n, 0) AS BIGINT) AS candidate_weight, n_pred, n_gold FROM tx t JOIN ws USING (id) LEFT JOIN {_ATTR('full_p', 'assertions', _ABLE)} pa USING (id) LEFT JOIN {_ATTR('full_g', 'assertions', _ABLE)} ga USING (id) LEFT JOIN {_ATTR('full_p', 'candidates', _LINK)} pc USING (id) LEFT JOIN {_ATTR('full_g', 'candidates', _LINK)} gc USING (id) LEFT JOIN (SELECT id, sum(len(candidates) + 1) AS n FROM full_g WHERE entity_type IN ({_LINK}) GROUP BY 1) cw USING (id))"
)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score's attributes are stand-ins (the tables hold none for these spans): a label by number, the canonical phrase as code."""
    p, g = _sides(spark, sf)
    docs = table(spark, sf, "calibration").filter("text is not null").select(F.col("sample_no").alias("id"), F.col("text").alias("doc"))
    label = F.array(F.concat(F.lit("x"), (F.col("no") % 3).cast("string")))
    p = p.join(docs, "id").withColumn("text", F.expr("substring(doc, start_pos + 1, end_pos - start_pos)")).withColumn("assertions", label).withColumn("candidates", F.array("canonical")).drop("doc", "canonical")
    g = g.withColumn("assertions", label).withColumn("candidates", F.array(F.lower("text")))
    return scoring.text_scores(p, g, docs.select("id").distinct())


@query(f"WITH RECURSIVE {_SCORES} SELECT * FROM ts")
def text_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


@query(f"WITH RECURSIVE {_SCORES}, a AS (SELECT avg(text) AS t, avg(assertions) AS s, CASE WHEN sum(candidate_weight) > 0 THEN sum(candidates * candidate_weight) / sum(candidate_weight) ELSE 1.0 END AS c FROM ts) SELECT round(t, 6) AS text_score, round(s, 6) AS assertions_score, round(c, 6)::DOUBLE AS candidates_score, round(0.3 * t + 0.3 * s + 0.4 * c, 6)::DOUBLE AS final_score FROM a")
def corpus_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.corpus_score(_scores(spark, sf))


@query(f"WITH RECURSIVE {_SIDES}, {_CONCEPTS} SELECT p.id, p.no, coalesce(g.start_pos, p.start_pos) AS start_pos, coalesce(g.end_pos, p.end_pos) AS end_pos, p.entity_type FROM pred p LEFT JOIN cm m ON m.id = p.id AND m.pred_no = p.no LEFT JOIN goldn g ON g.id = p.id AND g.no = m.gold_no")
def span_oracle(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.span_oracle(*_sides(spark, sf)).select("id", "no", "start_pos", "end_pos", "entity_type")


_ANY = f"ap AS (SELECT a.id, a.no AS pred_no, b.no AS gold_no, {_OV} AS shared FROM {_over('pred', 'goldn')}), " + greedy_sql("ap", "shared DESC", "am")


@query(f"WITH RECURSIVE {_SIDES}, {_ANY} SELECT p.id, p.no, p.start_pos, p.end_pos, coalesce(g.entity_type, p.entity_type) AS entity_type FROM pred p LEFT JOIN am m ON m.id = p.id AND m.pred_no = p.no LEFT JOIN goldn g ON g.id = p.id AND g.no = m.gold_no")
def type_oracle(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.type_oracle(*_sides(spark, sf)).select("id", "no", "start_pos", "end_pos", "entity_type")
