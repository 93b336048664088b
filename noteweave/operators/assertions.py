"""What is said about an entity: negated, in the past, of a relative. Cues, their scopes, and what breaks them.

Cue phrases are found once per text, in one pass; an entity then looks at its
text's cues as an array. A cue matches whole words as written, ignoring case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.text import lookup_key
from noteweave.operators.docs import per_text

# Cue phrases by kind, windows and thresholds.
RULES = {
    "negation_pre": ["không có", "không thấy", "không ghi nhận", "chưa ghi nhận", "chưa phát hiện", "phủ nhận", "loại trừ", "không"],
    "negation_post": ["không ghi nhận bất thường", "không bất thường", "âm tính", "bình thường"],
    "pseudo_negation": ["không loại trừ", "không rõ", "không chắc", "chưa rõ"],
    "historical": ["thuốc trước khi nhập viện", "trước khi nhập viện", "tiền sử", "trước đây", "đã từng", "mạn tính", "tại nhà", "đang dùng tại nhà", "đã ngừng", "ngừng uống", "cách nhập viện", "lần nhập viện trước"],
    "current": ["lý do nhập viện", "hiện tại", "lúc vào viện", "khi nhập viện", "được chỉ định", "được cho dùng", "được cho", "bắt đầu", "điều trị tại bệnh viện", "phát hiện mới", "tại cấp cứu"],
    "family": ["nhiều thành viên trong gia đình", "thành viên trong gia đình", "người nhà", "gia đình", "bố", "mẹ", "cha", "anh", "chị", "em", "con", "vợ", "chồng"],
    "experiencer": ["mắc", "có", "bị", "bệnh", "triệu chứng", "tương tự"],
    "reporter": ["phát hiện", "nhận thấy", "đưa", "kể", "báo", "cho biết", "gọi", "cung cấp"],
    "patient": ["bệnh nhân", "bn"],
}
TERMINATOR_WORDS = "nhưng|tuy nhiên|song"
SUBJECTS = "bệnh nhân|người bệnh|bn|bệnh nhi"
DRUG_CUES = "thuốc|đang dùng|ngừng uống|tại nhà|trước khi nhập viện|cách nhập viện"
WINDOW, BEFORE, AFTER = 160, 90, 48
THRESHOLDS = {"isNegated": 0.55, "isHistorical": 0.60, "isFamily": 0.80}
_WORD = re.compile(r"\w+")


def cue_hits(df: DataFrame, id: str, text: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, kind, cue, start_pos, end_pos): every place of every cue of ``rules``, a configuration of some hundred phrases. One pass, no exchange."""
    begins: dict[str, list[tuple[int, str, str]]] = {}
    for kind, cues in (rules or RULES).items():
        for cue in dict.fromkeys(c.strip().lower() for c in cues if c.strip()):
            found = _WORD.findall(cue)
            begins.setdefault(found[0], []).append((len(found), cue, kind))

    def cut(t: str) -> Iterator[tuple]:
        at = [m.span() for m in _WORD.finditer(t)]
        low = t.lower() if len(t.lower()) == len(t) else "".join(c.lower()[:1] for c in t)
        for i, (a, b) in enumerate(at):
            for n, cue, kind in begins.get(low[a:b], ()):
                if i + n <= len(at) and low[a : at[i + n - 1][1]] == cue:
                    yield kind, cue, a, at[i + n - 1][1]

    return per_text(df, id, text, [("kind", pa.string()), ("cue", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())], cut)


def _between(a: Column, b: Column) -> Column:
    return F.substring("doc", a + 1, F.greatest(b - a, F.lit(0)))


def ended(part: Column) -> Column:
    """Does a stretch of text end a cue's scope?"""
    return F.lower(part).rlike(rf"[.;\n]|(?:^|[^\p{{L}}\p{{N}}_])(?:{TERMINATOR_WORDS})(?:[^\p{{L}}\p{{N}}_]|$)")


def new_subject(part: Column) -> Column:
    """Does a stretch of text turn to the patient after a comma?"""
    return F.contains(part, F.lit(",")) & lookup_key(part).rlike(SUBJECTS)


def assert_entities(entities: DataFrame, texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``negation``, ``history`` and ``family`` (scores, 0 without evidence) and ``assertions`` to ``entities`` (id, start_pos, end_pos, entity_type, ...).

    ``texts``: id, doc. Types that cannot be asserted have no assertions.
    """
    g = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_pos").alias("a"), F.col("end_pos").alias("b"), "kind", "cue"))).alias("hs"))
    d = entities.join(texts.select("id", "doc"), "id").join(g, "id", "left")
    s, e = F.col("start_pos"), F.col("end_pos")
    d = d.withColumn("hs", F.filter("hs", lambda h: (h["b"] > s - WINDOW) & (h["a"] < e + WINDOW)))
    of = lambda kind: F.filter("hs", lambda h: h["kind"] == kind)
    low = F.greatest(s - WINDOW, F.lit(0))

    def pseudo(h: Column) -> Column:
        return F.exists(of("pseudo_negation"), lambda p: (p["a"] >= F.greatest(low, h["a"] - 30)) & (p["b"] <= s) & (p["a"] < h["b"]) & (p["b"] > h["a"]))

    before = F.exists(of("negation_pre"), lambda h: (h["a"] >= low) & (h["b"] <= s) & (s - h["b"] <= BEFORE) & ~pseudo(h) & ~ended(_between(h["b"], s)) & ~new_subject(_between(h["b"], s)))
    after = F.exists(of("negation_post"), lambda h: (h["a"] >= e) & (h["a"] - e <= AFTER) & (h["b"] <= e + WINDOW) & ~ended(_between(e, h["a"])))
    past = F.filter(of("historical"), lambda h: (h["a"] >= low) & (h["b"] <= e + WINDOW))
    current = F.exists(of("current"), lambda c: (c["a"] >= s - 100) & (c["b"] <= e + 60) & ~F.exists(past, lambda h: (h["a"] < c["b"]) & (c["a"] < h["b"])))
    drug = F.col("entity_type") == "THUỐC"
    applies = lambda h: drug | ~h["cue"].rlike(DRUG_CUES)
    score = lambda h: F.when(drug & h["cue"].rlike("trước khi nhập viện|tại nhà"), 0.90).when(h["cue"].rlike("tiền sử|đã từng|trước đây"), 0.88).when(h["cue"].rlike("ngừng|cách nhập viện"), 0.84).otherwise(0.75)
    earlier = F.filter(past, lambda h: (h["b"] <= s) & applies(h) & ~ended(_between(h["b"], s)))
    nearest = F.array_min(F.transform(earlier, lambda h: F.struct((s - h["b"]).alias("d"), h["a"].alias("a"), score(h).alias("score"))))["score"]
    later = F.exists(past, lambda h: (h["a"] >= e) & applies(h) & ~ended(_between(e, h["a"])))
    inside = lambda kind, a, b: F.exists(of(kind), lambda x: (x["a"] >= a) & (x["b"] <= b))
    relative = F.exists(of("family"), lambda h: (h["a"] >= low) & (h["b"] <= s) & ~ended(_between(h["b"], s)) & ~inside("reporter", h["b"], s) & ~inside("patient", h["b"], s) & inside("experiencer", h["b"], e + 40))
    yes = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumn("negation", F.when(yes(before), 0.90).when(yes(after), 0.72).otherwise(0.0))
    d = d.withColumn("history", F.when(yes(current), 0.0).when(nearest.isNotNull(), nearest).when(yes(later), 0.70).otherwise(0.0))
    d = d.withColumn("family", F.when(yes(relative), 0.90).otherwise(0.0))
    able = F.col("entity_type").isin("TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC")
    marks = [F.when(able & (F.col(c) >= THRESHOLDS[n]), n) for n, c in (("isNegated", "negation"), ("isHistorical", "history"), ("isFamily", "family"))]
    return d.withColumn("assertions", F.array_compact(F.array(*marks))).drop("doc", "hs")
