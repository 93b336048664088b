"""Queries on strings: normal forms, drug mentions, similarities, query variants, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import drugs
from noteweave.functions import text as tx
from noteweave.operators import linkers, views
from noteweave.plans.base import FOLD, KEY, SQUEEZE, STRIP, query, table

EDGE, OVER = r"(^|[^\pL\pN_])", r"([^\pL\pN_]|$)"
COMPOSED = KEY.format("nfc_normalize({0})")
BARE = KEY.format(STRIP.format("{0}"))
PUNCT = SQUEEZE.format("translate(regexp_replace({0}, '[\\[\\]()\\x7B\\x7D\"''`,;:“”‘’]', ' ', 'g'), '–—−', '---')")
TOKENS = "list_filter(regexp_split_to_array({0}, '[^\\pL\\pM\\pN_%+./\\-]+'), lambda t: t <> '')"
SLUG = "regexp_replace(regexp_replace(lower(" + STRIP.format("{0}") + "), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
APART = r"regexp_replace({0}, '(\d+(?:[.,]\d+)?)(mg|mcg|gm|g|ml|units|unit|%)([^\pL\pN_]|$)', '\1 \2\3', 'g')"
_LANG = "CASE WHEN regexp_matches(lower({0}), '[" + tx.VIETNAMESE_LETTERS + "]|" + "|".join(tx.VIETNAMESE_WORDS) + "') THEN 'vi' ELSE 'en' END"


def retrieval_sql(x: str) -> str:
    key, bare = COMPOSED.format(x), BARE.format(x)
    return f"CASE WHEN {bare} <> '' AND {bare} <> {key} THEN {key} || ' ' || {bare} ELSE {key} END"


def tokens_sql(text: str) -> str:
    """The tokens for retrieval of a retrieval text."""
    whole = TOKENS.format(KEY.format(APART.format(text)))
    return f"flatten(list_transform({whole}, lambda t: list_concat([t], CASE WHEN regexp_matches(t, '[/-]') THEN list_filter(regexp_split_to_array(t, '[/-]+'), lambda x: x <> '') ELSE [] END)))"


@query(
    f"SELECT alias_id, nfc_normalize(alias) AS nfc, {SQUEEZE.format('alias')} AS squeezed, {STRIP.format('alias')} AS bare, {PUNCT.format('alias')} AS light, {COMPOSED.format('alias')} AS norm_key, {BARE.format('alias')} AS bare_key, "
    f"array_to_string({TOKENS.format(COMPOSED.format('alias'))}, '|') AS tokens, {_LANG.format('alias')} AS lang, {SLUG.format('alias')} AS slug, {retrieval_sql('alias')} AS for_retrieval, array_to_string({tokens_sql('(' + retrieval_sql('alias') + ')')}, '|') AS retrieval_tokens, sha256({COMPOSED.format('alias')}) AS text_hash "
    "FROM symptoms_vi"
)
def text_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("alias")
    key, bare = tx.composed_key(a), tx.bare_key(a)
    d = table(spark, sf, "symptoms_vi").select("alias_id", "alias", tx.nfc(a).alias("nfc"), key.alias("norm_key"), bare.alias("bare_key"))
    text = tx.retrieval_text(F.col("norm_key"), F.col("bare_key"))
    return d.select(
        "alias_id", "nfc", tx.squeeze(a).alias("squeezed"), tx.strip_accents(a).alias("bare"), tx.strip_punctuation(a).alias("light"), "norm_key", "bare_key",
        F.array_join(tx.key_tokens(F.col("norm_key")), "|").alias("tokens"), tx.alias_language(a).alias("lang"), tx.slug(a).alias("slug"), text.alias("for_retrieval"),
        F.array_join(tx.retrieval_tokens(text), "|").alias("retrieval_tokens"), F.sha2(F.col("norm_key"), 256).alias("text_hash"),
    )


@query("SELECT alias_id, coalesce(notes, '') AS note_text, upper(trim(coalesce(code_hint, ''))) AS code, replace(upper(trim(coalesce(code_hint, ''))), '.', '') AS dotless FROM diagnosis_aliases")
def code_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "diagnosis_aliases").select("alias_id", tx.ensure_text(F.col("notes")).alias("note_text"), tx.code_key(F.col("code_hint")).alias("code"), tx.dotless(F.col("code_hint")).alias("dotless"))


_P = f"list_transform(v, lambda x: {{'k': {KEY.format('x')}, 'v': {SQUEEZE.format('x')}}})"


@query(f"WITH p AS (SELECT alias_id, list_filter({_P}, lambda x: x.k <> '') AS p FROM (SELECT alias_id, [alias, canonical_hint, upper(alias), notes] AS v FROM diagnosis_aliases)) SELECT alias_id, array_to_string(list_transform(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: y.k), x.k) = i), lambda x: x.v), '|') AS names FROM p")
def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    v = F.array("alias", "canonical_hint", F.upper("alias"), "notes")
    return table(spark, sf, "diagnosis_aliases").select("alias_id", F.array_join(tx.distinct_by_key(v), "|").alias("names"))


# --- drug mentions -----------------------------------------------------------------------------------------------------


def _out(x: str, words: str) -> str:
    one = rf"regexp_replace({{}}, '{EDGE}(?:{words}){OVER}', '\1 \2', 'g')"
    return one.format(one.format(x))


def name_sql(x: str) -> str:
    grams = rf"regexp_replace({x}, '(\d+(?:[.,]\d+)?)\s*(?i:gram)([^\pL\pN_]|$)', '\1 G\2', 'g')"
    t = f"translate(lower({grams}), '/+', '  ')"
    t = _out(t, drugs.WORDS_OF_AND)
    t = _out(t, drugs.AMOUNT)
    for words in (drugs.ROUTES, drugs.FREQUENCIES, drugs.FORMS, drugs.NOISE):
        t = _out(t, words)
    t = SQUEEZE.format(f"regexp_replace({t}, '\\([^)]*\\)', ' ', 'g')")
    edge = r"""^[\-,:;()\[\]{}<>"''./]+|[\-,:;()\[\]{}<>"''./]+$"""
    return f"array_to_string(list_filter(list_transform(string_split({t}, ' '), lambda w: regexp_replace(w, '{edge}', '', 'g')), lambda w: w <> '' AND NOT regexp_matches(w, '^\\d+(?:\\.\\d+)?$')), ' ')"


def _found(x: str, words: str) -> str:
    return f"nullif(regexp_extract(lower({x}), '{EDGE}({words}){OVER}', 2), '')"


STRENGTH_VALUE = f"TRY_CAST(replace(regexp_extract(lower({{0}}), '{drugs.STRENGTH}', 1), ',', '.') AS DOUBLE)"
STRENGTH_UNIT = f"nullif(upper(regexp_replace(regexp_extract(lower({{0}}), '{drugs.STRENGTH}', 2), '\\s+', '', 'g')), '')"
_GRAMS = r"regexp_replace(t, '(\d+(?:[.,]\d+)?)\s*(?i:gram)([^\pL\pN_]|$)', '\1 G\2', 'g')"
_FORM = "CASE " + " ".join(f"WHEN contains(lower(t), '{f.lower()}') THEN '{f}'" for f in drugs.DOSE_FORMS) + " ELSE '' END"
_FIRST = f"regexp_extract(lower(t), '{drugs.STRENGTH}')"
_BEFORE = f"regexp_replace(regexp_replace(CASE WHEN {_FIRST} = '' THEN t ELSE left(t, strpos(lower(t), {_FIRST}) - 1) END, '\\[[^\\]]+\\]', ' ', 'g'), '\\s*/\\s*', ' / ', 'g')"
PARSED = f"parsed AS (SELECT *, nullif({KEY.format(name_sql('t'))}, '') AS name, {STRENGTH_VALUE.format(_GRAMS)} AS sv, {STRENGTH_UNIT.format(_GRAMS)} AS su, {_found('t', drugs.ROUTES)} AS rt, {_found('t', drugs.FREQUENCIES)} AS fq, {_found('t', drugs.FORMS)} AS fm, coalesce(regexp_matches(lower(t), '[/+]|{EDGE}(?:{drugs.WORDS_OF_AND}){OVER}'), false) AS cb FROM mention)"


@query(
    f"WITH mention AS (SELECT mention_id, raw, {SQUEEZE.format('raw')} AS t FROM parsed_drug), {PARSED} SELECT mention_id, name, sv AS strength_value, su AS strength_unit, rt AS route, fq AS frequency, fm AS dose_form, cb AS is_combination, "
    f"{SQUEEZE.format(f'''regexp_replace({_BEFORE}, '^[ /-]+|[ /-]+$', '', 'g')''')} AS ingredient, CASE WHEN raw IS NOT NULL THEN {_FORM} END AS form_guess, regexp_replace({APART.format('lower(t)')}, '{EDGE}mg\\s*/\\s*ml{OVER}', '\\1mg/ml\\2', 'g') AS spaced FROM parsed"
)
def drug_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    p = table(spark, sf, "parsed_drug").select("mention_id", "raw", drugs.parse(raw).alias("p"))
    return p.select(
        "mention_id", "p.*", drugs.ingredient(raw).alias("ingredient"), drugs.dose_form(tx.squeeze(raw)).alias("form_guess"), drugs.spaced_units(F.lower(tx.squeeze(raw))).alias("spaced")
    )


@query(f"WITH mention AS (SELECT alias_id, {SQUEEZE.format('alias')} AS t, alias FROM drug_aliases), n AS (SELECT alias_id, alias, {name_sql('t')} AS name FROM mention) SELECT alias_id, 'full' AS kind, alias AS query FROM n WHERE {KEY.format('alias')} <> '' UNION ALL SELECT alias_id, 'name', name FROM n WHERE {KEY.format('name')} <> '' AND ({KEY.format('alias')} = '' OR {KEY.format('name')} <> {KEY.format('alias')})")
def drug_query_variants(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "drug_aliases").select("alias_id", F.explode(drugs.query_variants(F.col("alias"))).alias("v"))
    return d.select("alias_id", "v.kind", "v.query")


_ABBREVIATIONS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in linkers.ABBREVIATIONS.items()) + "}"
_VARIANTS = f"list_concat([m, {KEY.format('m')}, {BARE.format('m')}], CASE WHEN x IS NULL THEN [] ELSE [x, {BARE.format('x')}] END)"
DIAGNOSIS_VARIANTS = f"variants AS (SELECT id, m, list_filter(list_transform({_VARIANTS}, lambda v: trim(v)), lambda v: v <> '') AS vs FROM (SELECT id, m, {_ABBREVIATIONS}[{KEY.format('m')}] AS x FROM mentions)), queries AS (SELECT id, m, unnest(list_filter(vs, lambda v, i: list_position(list_transform(vs, lambda y: {KEY.format('y')}), {KEY.format('v')}) = i)) AS query, generate_subscripts(list_filter(vs, lambda v, i: list_position(list_transform(vs, lambda y: {KEY.format('y')}), {KEY.format('v')}) = i), 1) AS rank FROM variants)"


@query(f"WITH mentions AS (SELECT alias_id AS id, alias AS m FROM diagnosis_aliases WHERE alias IS NOT NULL), {DIAGNOSIS_VARIANTS} SELECT id, CAST(rank AS INTEGER) AS rank, query FROM queries")
def diagnosis_query_variants(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "diagnosis_aliases").filter("alias is not null").select(F.col("alias_id").alias("id"), F.posexplode(linkers.diagnosis_queries(F.col("alias"))).alias("rank", "query"))
    return d.select("id", (F.col("rank") + 1).alias("rank"), "query")


# --- similarities ------------------------------------------------------------------------------------------------------

_SETS = f"s AS (SELECT alias_id, list_distinct(list_filter(string_split({KEY.format('canonical')}, ' '), lambda t: t <> '')) AS q, list_distinct(list_filter(string_split({KEY.format('alias')}, ' '), lambda t: t <> '')) AS a FROM symptoms_vi)"
SIMILARITY = "CASE WHEN len(list_intersect({0}, {1})) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.8 * (2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1}))) + 0.2 * (least(len({0}), len({1})) / greatest(len({0}), len({1}))::DOUBLE))) END"


@query(f"WITH {_SETS} SELECT alias_id, round({SIMILARITY.format('q', 'a')}, 6)::DOUBLE AS similarity, round(CASE WHEN len(q) + len(a) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(q, a)) / (len(q) + len(a)) END, 6)::DOUBLE AS token_f1 FROM s")
def alias_similarity(spark: SparkSession, sf: str) -> DataFrame:
    q, a = tx.lookup_key(F.col("canonical")), tx.lookup_key(F.col("alias"))
    tokens = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    return table(spark, sf, "symptoms_vi").select("alias_id", F.round(tx.alias_similarity(q, a), 6).alias("similarity"), F.round(tx.token_f1(tokens(q), tokens(a)), 6).alias("token_f1"))


_STEP = "list_concat([i + 1], list_transform(h, lambda w, j: least(d[j + 1] + 1, d[j] + CASE WHEN w = r[i + 1] THEN 0 ELSE 1 END)))"
WER = (
    "dp AS (SELECT id, r, h, 0 AS i, CAST(range(0, len(h) + 1) AS BIGINT[]) AS d FROM pairs WHERE len(r) > 0 UNION ALL "
    f"SELECT id, r, h, i + 1, CAST(list_transform(s, lambda v, j: list_min(list_transform(s[1:j], lambda x, k: x - k)) + j) AS BIGINT[]) FROM (SELECT id, r, h, i, {_STEP} AS s FROM dp WHERE i < len(r)))"
)


_W = "list_filter(string_split(" + SQUEEZE.format("coalesce({0}, '')") + ", ' '), lambda t: t <> '')"


@query(f"WITH RECURSIVE pairs AS (SELECT alias_id AS id, {_W.format('canonical')} AS r, {_W.format('alias')} AS h FROM symptoms_vi), {WER} SELECT id AS alias_id, round(d[len(h) + 1] / len(r)::DOUBLE, 6) AS wer FROM dp WHERE i = len(r) UNION ALL SELECT id, CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END FROM pairs WHERE len(r) = 0")
def wer_score(spark: SparkSession, sf: str) -> DataFrame:
    from noteweave.functions.wer import wer

    return table(spark, sf, "symptoms_vi").select("alias_id", F.round(wer(F.col("canonical"), F.col("alias")), 6).alias("wer"))


# --- views -------------------------------------------------------------------------------------------------------------

_CHARS = "c AS (SELECT alias_id, alias, list_transform(regexp_extract_all(alias, '(?s).'), lambda x, i: {'raw': x, 'at': i - 1}) AS cs FROM symptoms_vi WHERE alias IS NOT NULL)"
_FOLDED = f"f AS (SELECT alias_id, alias, list_filter(list_transform(cs, lambda x: {{'c': CASE WHEN regexp_matches(x.raw, '[\\s\u00a0]') THEN ' ' ELSE {STRIP.format('lower(x.raw)')} END, 'at': x.at}}), lambda x: x.c <> '') AS fs FROM c)"
_VIEWED = "v AS (SELECT alias_id, alias, list_filter(fs, lambda x, i: x.c <> ' ' OR i = 1 OR fs[i - 1].c <> ' ') AS vs FROM f)"


@query(f"WITH {_CHARS}, {_FOLDED}, {_VIEWED} SELECT alias_id, array_to_string(list_transform(vs, lambda x: x.c), '') AS view, array_to_string(list_transform(vs, lambda x: x.at), ',') AS raw_at, CASE WHEN len(vs) >= 4 THEN substring(alias, CAST(vs[2].at + 1 AS BIGINT), CAST(vs[4].at + 1 - vs[2].at AS BIGINT)) END AS back FROM v")
def mapped_view(spark: SparkSession, sf: str) -> DataFrame:
    d = views.folded_view(table(spark, sf, "symptoms_vi").filter("alias is not null").select("alias_id", "alias"), "alias")
    start, end = views.to_raw(F.col("raw_at"), F.lit(1), F.lit(4))
    back = F.when(F.size("raw_at") >= 4, views.safe_slice(F.col("alias"), start, end))
    return d.select("alias_id", "view", F.array_join("raw_at", ",").alias("raw_at"), back.alias("back"))


_NEAR = "near AS (SELECT sample_no AS id, text AS doc, e.text AS span, greatest(0, e.start_pos + shift - 5) AS lo, least(length(text), e.end_pos + shift + 5) AS hi, shift FROM (SELECT sample_no, text, unnest(entities) AS e FROM calibration WHERE text IS NOT NULL), (SELECT unnest([-3, 0, 4, 9]) AS shift)), w AS (SELECT *, substring(doc, CAST(lo + 1 AS BIGINT), CAST(greatest(hi - lo, 0) AS BIGINT)) AS seg FROM near)"


@query(f"WITH {_NEAR} SELECT id, shift, span, lo + strpos(seg, span) - 1 AS start_pos, lo + strpos(seg, span) - 1 + length(span) AS end_pos FROM w WHERE length(span) > 0 AND strpos(seg, span) > 0 AND strpos(substring(seg, strpos(seg, span) + 1), span) = 0")
def repaired_spans(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "calibration").filter("text is not null").select(F.col("sample_no").alias("id"), "text", F.explode("entities").alias("e"))
    d = d.select("id", "text", F.col("e.text").alias("span"), "e.start_pos", "e.end_pos", F.explode(F.array(*map(F.lit, (-3, 0, 4, 9)))).alias("shift"))
    found = views.repair_span(F.col("text"), F.col("start_pos") + F.col("shift"), F.col("end_pos") + F.col("shift"), F.col("span"))
    return d.select("id", "shift", "span", found.alias("r")).filter("r is not null").select("id", "shift", "span", "r.start_pos", "r.end_pos")
