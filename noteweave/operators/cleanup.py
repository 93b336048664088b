"""Entities cleaned after linking: duplicates merged, spans trimmed, non-entities dropped, attributes put in order, overlaps resolved.

Entities are (id, start_pos, end_pos, text, entity_type, assertions, candidates,
confidence, source_rank, ...), texts (id, doc). Nulls in arrays' place are empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import lookup_key
from noteweave.operators.views import sentence_around, trimmed

ASSERTABLE = ["TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC"]
LINKED = ["CHẨN_ĐOÁN", "THUỐC"]
ASSERTION_ORDER = ["isNegated", "isFamily", "isHistorical"]
TYPE_ORDER = {"TÊN_XÉT_NGHIỆM": 10, "KẾT_QUẢ_XÉT_NGHIỆM": 20, "THUỐC": 30, "CHẨN_ĐOÁN": 40, "TRIỆU_CHỨNG": 50}
# What is trimmed from spans, what is no entity, what speaks for a drug or against one.
NEGATION_CUES = ["không có", "không thấy", "không ghi nhận", "chưa phát hiện", "phủ nhận", "không"]
DIAGNOSIS_TRIGGERS = ["lo ngại", "nghi ngờ", "chẩn đoán", "phát hiện", "cho thấy", "gợi ý"]
SUBJECT_TRIGGERS = ["bệnh nhân xuất hiện", "bệnh nhân có", "bệnh nhân còn", "người bệnh xuất hiện", "người bệnh có", "xuất hiện", "ghi nhận", "cảm thấy"]
EDGE = r" \t\r\n\-•*:;,。."
RESULT_WORDS = ["bình thường", "âm tính", "dương tính"]
GENERIC = ["bệnh", "bệnh nhân", "người bệnh", "bệnh hiện tại", "yếu tố nguy cơ", "yếu tố nguy cơ liên quan", "các triệu chứng hiện tại", "triệu chứng hiện tại", "tình trạng"]
MEDICATION_CUES = ["thuốc", "dùng", "điều trị", "được cho", "bắt đầu", "ngừng", "kê đơn", "liều", "tiêm", "truyền", "mg", "mcg", "iv", "po"]
SUBSTANCES = ["caffeine", "cà phê", "rượu bia", "thuốc lá", "hút thuốc"]
NOT_MEDICATION = ["thuốc lá", "hút thuốc"]
SYMPTOM_HEADS = ["đau", "khó thở", "đánh trống ngực", "cảm giác đánh trống ngực", "cảm giác thắt chặt ngực", "ý thức suy giảm", "ho", "sốt", "buồn nôn", "nôn", "tiêu chảy", "táo bón", "chóng mặt", "mệt mỏi", "yếu", "ngất", "phù", "sưng", "chảy máu", "khó nuốt", "khò khè", "lo âu", "mất ngủ", "ảo giác", "lú lẫn", "nhìn mờ"]
DISEASE_HEADS = ["viêm", "ung thư", "u ác", "u tuyến", "suy", "xơ gan", "rung nhĩ", "nhồi máu", "thuyên tắc", "xuất huyết", "hẹp", "tắc", "bóc tách", "gãy", "áp xe", "nhiễm khuẩn", "nhiễm trùng", "bệnh", "hội chứng", "loét", "tràn dịch", "phình động mạch"]


def begins_with_any(key: Column, heads: list[str]) -> Column:
    return key.rlike(f"^(?:{'|'.join(heads)})(?: |$)")


def type_rank(c: Column) -> Column:
    """The place of a type in the output; 999 for an unknown one."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TYPE_ORDER.items() for x in kv))[c], F.lit(999))


def ordered_assertions(c: Column) -> Column:
    """The known assertions of an array, once each, in their fixed order."""
    return F.filter(F.array(*map(F.lit, ASSERTION_ORDER)), lambda a: F.array_contains(F.coalesce(c, F.array().cast("array<string>")), a))


def distinct_trimmed(c: Column) -> Column:
    """The trimmed values of an array, without empty ones, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


def clean_attributes(entities: DataFrame) -> DataFrame:
    """Candidates only for linked types, assertions only for assertable ones, both distinct and in order."""
    none = F.array().cast("array<string>")
    return entities.withColumn("candidates", F.when(F.col("entity_type").isin(LINKED), distinct_trimmed(F.col("candidates"))).otherwise(none)).withColumn(
        "assertions", F.when(F.col("entity_type").isin(ASSERTABLE), ordered_assertions(F.col("assertions"))).otherwise(none)
    )


def merge_exact(entities: DataFrame) -> DataFrame:
    """One entity per (id, start, end, type): the best by confidence, source rank, number of candidates and row, with all assertions, all candidates (in order of ``row``) and the greatest confidence."""
    keys = ["id", "start_pos", "end_pos", "entity_type"]
    best = F.max_by("row", F.struct("confidence", "source_rank", F.size(F.coalesce("candidates", F.array().cast("array<string>"))).alias("n"), (-F.col("row")).alias("r")))
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))
    g = entities.groupBy(keys).agg(best.alias("row"), in_order("assertions").alias("assertions"), in_order("candidates").alias("candidates"), F.max("confidence").alias("confidence"), F.count("*").alias("n_merged"))
    return g.withColumn("assertions", ordered_assertions(F.col("assertions"))).withColumn("candidates", distinct_trimmed(F.col("candidates")))


def _after_cue(rest: Column, cues: list[str], head: list[str] | None) -> Column:
    """How far a leading cue and the edge characters after it reach; 0 without one, or if no known head follows."""
    key = lookup_key(rest)
    out = F.lit(0)
    for cue in sorted(cues, key=len):
        past = F.lit(len(cue)) + F.length(F.regexp_extract(F.substring(rest, F.lit(len(cue) + 1), F.length(rest)), f"^[{EDGE}]*", 0))
        found = F.startswith(key, F.lit(cue + " "))
        if head:
            found = found & begins_with_any(lookup_key(F.substring(rest, past + 1, F.length(rest))), head)
        out = F.when(found, past).otherwise(out)
    return out


def trim_spans(entities: DataFrame) -> DataFrame:
    """Spans without edge characters, without a leading negation (which makes the entity negated), diagnosis trigger or subject phrase; the latter two only before a known head. ``doc``: the text."""
    d = entities
    a, b = trimmed(F.col("doc"), F.col("start_pos"), F.col("end_pos"), EDGE)
    d = d.withColumn("_a", a).withColumn("_b", b)
    rest = lambda: F.substring("doc", F.col("_a") + 1, F.col("_b") - F.col("_a"))
    step = F.when(F.col("entity_type").isin(ASSERTABLE), _after_cue(rest(), NEGATION_CUES, None)).otherwise(0)
    d = d.withColumn("_n", step).withColumn("_a", F.col("_a") + F.col("_n"))
    d = d.withColumn("_a", F.col("_a") + F.when(F.col("entity_type") == "CHẨN_ĐOÁN", _after_cue(rest(), DIAGNOSIS_TRIGGERS, DISEASE_HEADS)).otherwise(0))
    subject = F.when(F.col("entity_type") == "TRIỆU_CHỨNG", _after_cue(rest(), SUBJECT_TRIGGERS, SYMPTOM_HEADS)).when(F.col("entity_type") == "CHẨN_ĐOÁN", _after_cue(rest(), SUBJECT_TRIGGERS, DISEASE_HEADS)).otherwise(0)
    d = d.withColumn("_a", F.col("_a") + subject)
    a, b = trimmed(F.col("doc"), F.col("_a"), F.col("_b"), EDGE)
    d = d.withColumn("_x", a).withColumn("_y", b)
    some = F.col("_x") < F.col("_y")
    negated = F.array_union(F.coalesce("assertions", F.array().cast("array<string>")), F.array(F.lit("isNegated")))
    d = d.withColumn("assertions", F.when(some & (F.col("_n") > 0), ordered_assertions(negated)).otherwise(F.coalesce("assertions", F.array().cast("array<string>"))))
    d = d.withColumn("start_pos", F.when(some, F.col("_x")).otherwise(F.col("start_pos"))).withColumn("end_pos", F.when(some, F.col("_y")).otherwise(F.col("end_pos")))
    return d.withColumn("text", F.substring("doc", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))).drop("_a", "_b", "_n", "_x", "_y")


def drop_reason(has_slots: Column) -> Column:
    """Why an entity is none; empty if it is one. Uses text, entity_type, start_pos, end_pos, doc; ``has_slots``: the drug has a strength, route or frequency."""
    key = lookup_key(F.col("text"))
    words = F.size(F.split(key, " "))
    generic = F.col("entity_type").isin("TRIỆU_CHỨNG", "CHẨN_ĐOÁN") & (key.isin(GENERIC) | key.rlike("^(?:bệnh nhân|người bệnh) ") | (F.startswith(key, F.lit("bệnh ")) & (words <= 2)))
    result = (F.col("entity_type") != "KẾT_QUẢ_XÉT_NGHIỆM") & key.isin(RESULT_WORDS)
    around = lookup_key(sentence_around(F.col("doc"), F.col("start_pos"), F.col("end_pos")))
    other = around
    for phrase in NOT_MEDICATION:
        other = F.replace(other, F.lit(phrase), F.lit(" "))
    food = (F.col("entity_type") == "THUỐC") & ~has_slots & around.rlike("|".join(SUBSTANCES)) & ~other.rlike("|".join(MEDICATION_CUES))
    return F.when(generic, "generic_problem_phrase").when(result, "non_lab_qualitative_result").when(food, "drug_without_dose_in_food_or_substance_context").otherwise("")


# --- overlaps ----------------------------------------------------------------------------------------------------------


def _contains(a, b) -> bool:  # noqa: ANN001
    return a.start_pos <= b.start_pos and b.end_pos <= a.end_pos


def _share(a, b) -> float:  # noqa: ANN001
    both = min(a.end_pos, b.end_pos) - max(a.start_pos, b.start_pos)
    return both / (a.end_pos - a.start_pos + b.end_pos - b.start_pos - both)


def _same_type(a, b):  # noqa: ANN001, ANN202
    """(loser of two, reason), or nothing if both stay."""
    if a.entity_type != b.entity_type:
        return None
    nested = a.entity_type not in ("TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM") and (_contains(a, b) or _contains(b, a))
    if not nested and _share(a, b) < 0.8:
        return None
    return (a if b.strength > a.strength else b), "same_type_overlap"


def _other_type(a, b):  # noqa: ANN001, ANN202
    if a.entity_type == b.entity_type or not (_contains(a, b) or _contains(b, a) or _share(a, b) >= 0.8):
        return None
    for x, y in ((a, b), (b, a)):
        if x.entity_type == "KẾT_QUẢ_XÉT_NGHIỆM":
            return y, "lab_result_priority"
        if x.entity_type == "TÊN_XÉT_NGHIỆM" and x.by_rule:
            return y, "test_name_source_priority"
        if x.entity_type == "THUỐC" and x.n_codes:
            return y, "linked_drug_priority"
    if {a.entity_type, b.entity_type} == {"CHẨN_ĐOÁN", "TRIỆU_CHỨNG"}:
        for kind, head, reason in (("CHẨN_ĐOÁN", "disease_head", "diagnosis_disease_head_priority"), ("TRIỆU_CHỨNG", "symptom_head", "symptom_head_priority")):
            for x, y in ((a, b), (b, a)):
                if x.entity_type == kind and getattr(x, head):
                    return y, reason
        return (b if a.confidence >= b.confidence else a), "higher_confidence"
    return (a if b.strength > a.strength else b), "higher_overlap_rank"


def _resolve(p: pd.DataFrame) -> pd.DataFrame:
    """Each text's spans in order; the first clashing pair loses a member, then the next, until none clashes: spans of one type first, then of different ones.

    Whether two spans clash depends on them alone, so a loss never opens a pair that was passed before.
    """
    rows = [_Span(r) for r in p.sort_values(["start_pos", "end_pos", "entity_type", "row"]).itertuples()]
    gone: dict[int, str] = {}
    for decide in (_same_type, _other_type):
        i = 0
        while i < len(rows):
            lost = None
            for j in range(i + 1, len(rows)):
                if rows[j].start_pos >= rows[i].end_pos:
                    break
                if lost := decide(rows[i], rows[j]):
                    break
            if not lost:
                i += 1
                continue
            gone[lost[0].row] = lost[1]
            rows = [r for r in rows if r is not lost[0]]
    out = p[["id", "row"]].copy()
    out["lost_by"] = [gone.get(r, "") for r in p["row"]]
    return out


class _Span:
    __slots__ = ("row", "start_pos", "end_pos", "entity_type", "confidence", "by_rule", "n_codes", "disease_head", "symptom_head", "strength")

    def __init__(self, r) -> None:  # noqa: ANN001
        for name in self.__slots__[:-1]:
            setattr(self, name, getattr(r, name))
        slots = r.n_slots if r.entity_type == "THUỐC" else int(bool(r.plain)) if r.entity_type in ("TRIỆU_CHỨNG", "CHẨN_ĐOÁN") else 0
        self.strength = (slots, r.confidence, r.end_pos - r.start_pos, -TYPE_ORDER.get(r.entity_type, 999))


def resolve_overlaps(entities: DataFrame) -> DataFrame:
    """(id, row, lost_by): which entities give way to an overlapping one, and by which rule; empty for those that stay.

    The order of decisions is part of the result, so each text's spans meet in
    one function call. ``entities``: id, row, start_pos, end_pos, entity_type,
    confidence, by_rule, n_codes, n_slots, plain, disease_head, symptom_head.
    """
    kind = {f: entities.schema[f].dataType.simpleString() for f in ("id", "row")}
    return entities.groupBy("id").applyInPandas(_resolve, f"id {kind['id']}, row {kind['row']}, lost_by string")


def remaining_overlaps(entities: DataFrame) -> DataFrame:
    """(id, n): pairs of overlapping entities left in each text that has some."""
    a, b = entities.alias("a"), entities.alias("b")
    before = F.struct("a.start_pos", "a.end_pos", "a.row") < F.struct("b.start_pos", "b.end_pos", "b.row")
    on = (F.col("a.id") == F.col("b.id")) & before & (F.col("b.start_pos") < F.col("a.end_pos"))
    return a.join(b, on).groupBy(F.col("a.id").alias("id")).agg(F.count("*").alias("n"))


def final_order(entities: DataFrame) -> DataFrame:
    """Adds ``place``, the order in the output: by position, type and text."""
    w = W.partitionBy("id").orderBy("start_pos", "end_pos", type_rank(F.col("entity_type")), "text", "row")
    return entities.withColumn("place", F.row_number().over(w))
