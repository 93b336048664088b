"""Hand-typed values mapped to the entry of a reference list they mean.

All of it is built-in expressions and joins. Both sides are reduced to a key of
letters and digits (accents, case, spaces and punctuation dropped, remarks,
strengths, routes and the like removed by a list of replacements). The reference
side adds a key for each way an entry is written: other word orders, initials,
Telex keystrokes, the English name.

Equal keys match first. The rest goes through a partition-based pigeonhole join:
a reference key is cut into k + 1 segments, one of which survives k edits, so an
equality join on (key length, segment, substring) at the k + 1 nearest positions
finds every key within k edits; the built-in ``levenshtein`` verifies. The
nearest entry counts if it is the only one at that distance; what has none is
reported as unmatched, by anti-join.

The reference list is a fixed table; it is broadcast only while its keys number
``BROADCAST_ROWS`` or less, else Spark chooses the join. Values are matched once
per different text, so a text that a third of the rows share costs as much as one.

Null, empty and unreadable values are unmatched.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.session import cut_lineage

BROADCAST_ROWS = 50_000
EDITS = {"diagnosis": 2, "drug": 3}

VOWELS = "aăâeêioôơuưy"
TONES = {"f": "̀", "s": "́", "r": "̉", "x": "̃", "j": "̣"}
TONED = {t: "".join(unicodedata.normalize("NFC", v + m) for v in VOWELS) for t, m in TONES.items()}
ACCENTED = "".join(TONED.values()) + "ăâêôơưđ"
BARE = "".join(unicodedata.normalize("NFD", c.replace("đ", "d"))[0] for c in ACCENTED)

# How a diagnosis of the reference list is put together.
HEADS = "viêm,loét,hẹp,giãn,sỏi,u lành,áp xe,xơ hoá,thoái hoá,xuất huyết,tắc nghẽn,suy chức năng,chấn thương,nhiễm nấm".split(",")
MODIFIERS = "cấp tính,mạn tính,típ 1,típ 2,bên trái,bên phải,bẩm sinh,tái phát,do thuốc,sau phẫu thuật,có biến chứng,không biến chứng,ở trẻ em".split(",")
# Replacements (Java and RE2 alike) on lower case without accents, in order.
DIAGNOSIS_RULES = [
    (r"\s+", " "), (r"^[ \-.:*]+", ""), (r"^(?:(?:nghi ngo|nghi|td|theo doi|tien su|chan doan|cd|c/d|benh|bi)(?: |:|,)+)+", ""),
    (r",? ?khong dac hieu", ""), (r"\(cu\)|\?+", ""), (r" ?(?:dang dieu tri|da dieu tri|tu nam ngoai|cu)[ .]*$", ""),
    (r"\(t\)", "ben trai"), (r"\(p\)", "ben phai"), (r"\b(?:tuyp|typ|type|tup|tip) ?", "tip "), (r"\btip (?:ii|2)\b", "tip 2"), (r"\btip (?:i|1)\b", "tip 1"),
    (r"\b(?:hau phau|sau mo)\b", "sau phau thuat"), (r"\bvi thuoc\b", "do thuoc"), (r"\btu khi sinh\b", "bam sinh"), (r"\b(?:tai di tai lai|tai phat nhieu lan)\b", "tai phat"),
    (r"\b(?:khong co|chua|chua co) bien chung\b", "khong bien chung"), (r"\bkem(?: theo)? bien chung\b", "co bien chung"), (r"\b(?:o )?tre (?:nho|em)\b", "o tre em"),
    (r"\b(?:the )?cap(?: tinh)?\b", "cap tinh"), (r"\bkinh nien\b|\b(?:the )?man(?: tinh)?\b", "man tinh"), (r"\blien quan(?: den)? thuoc\b", "do thuoc"), (r"\bben t[ .]*$", "ben trai"), (r"\bben p[ .]*$", "ben phai"), (r"(?:ben ?)?\b(trai|phai)[ .]*$", "ben $1"),
    (r"[^a-z0-9]", ""),
]
DRUG_RULES = [
    (r"\s+", " "), (r"\([^)]*\)?", " "), (r"^[ \-.:*]+", ""), (r"^(?:(?:toa cu|don cu|dung dich|dang dung|dung|thuoc xit|thuoc|vien nen|vien nang|vien|hon dich|ong|lo|goi bot|goi|mieng dan|x \d+|\d+ (?:vien|ong|goi|lo))(?: |:)+)+", ""),
    (r"\b\d[\d.,]* ?(?:mg|mcg|ug|µg|μg|g|gam|gram|ml|iu|ui|dv|unt|units|%)\b(?: ?/ ?\d* ?(?:ml|l))?", " "), (r"\b\d[\d.,]* ?%", " "),
    (r"\b(?:sang \d+ chieu \d+|ngay \d+ lan|q\d+h|bid|tid|qid|qd|qhs|prn|moi toi|cach ngay|lieu thap|lieu cao|tu tuan truoc|trong ngay|tu hom qua|generic)\b", " "),
    (r"\b(?:tiem bap|truyen tinh mach|tiem tinh mach|boi ngoai|ngam duoi luoi|uong|po|iv|im|sc)\b", " "),
    (r" (?:natri|kali|maleat|acetat|hcl|hydroclorid|sulfat|forte|sr|xr|er|mr|tab|inj|caps|vien)\b\.?", " "), (r" (?:va|with|and|cung|kem) ", " "), (r"(?:^| )\d[\d.,]*(?: |$)", " "),
    (r"0", "o"), (r"1", "l"), (r"[^a-z]", ""),
]
#: A name cut short is looked up by its beginning if that many letters are left.
SHORTEST_STEM = 6


def fold(c: Column) -> Column:
    """Lower case without accents, as a built-in expression."""
    return F.translate(F.lower(c), ACCENTED, BARE)


def apply_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(c)


def _letters(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def telex(c: Column) -> Column:
    """The keystrokes that type a text in the Telex method, tone last in each syllable."""
    toned = "".join(TONED.values())

    def syllable(s: Column) -> Column:
        bare = F.translate(s, toned, VOWELS * len(TONED))
        for letter, keys in (("â", "aa"), ("ă", "aw"), ("ê", "ee"), ("ô", "oo"), ("ơ", "ow"), ("ư", "uw"), ("đ", "dd")):
            bare = F.replace(bare, F.lit(letter), F.lit(keys))
        tone = F.lit("")
        for key, letters in TONED.items():
            tone = F.when(s.rlike(f"[{letters}]"), key).otherwise(tone)
        return F.concat(bare, tone)

    return F.array_join(F.transform(F.split(F.lower(c), " "), syllable), " ")


def _initials(c: Column) -> Column:
    return F.array_join(F.transform(F.split(fold(c), " "), lambda s: F.substring(s, 1, 1)), "")


def diagnosis_keys(reference: DataFrame) -> DataFrame:
    """(key, code, modifier, exact_only): each way a diagnosis is written."""
    name = F.col("name_vi")
    head, modifier = f"^(?:{'|'.join(HEADS)})", f"(?:{'|'.join(MODIFIERS)})$"
    parts = reference.select("code", name, "name_en", F.regexp_extract(name, head, 0).alias("h"), F.regexp_extract(name, modifier, 0).alias("m"))
    organ = F.trim(F.regexp_replace(F.regexp_replace(name, head, ""), modifier, ""))
    parts = parts.withColumn("o", organ)
    orders = [("h", "o", "m"), ("o", "h", "m"), ("h", "m", "o")]
    forms = [F.struct(_letters(F.concat(*(F.col(x) for x in o))).alias("key"), F.lit(False).alias("exact_only")) for o in orders]
    forms.append(F.struct(_letters(F.col("name_en")).alias("key"), F.lit(False).alias("exact_only")))
    english = F.split(F.lower(F.col("name_en")), " ")
    turned = (F.concat(F.slice(english, 2, 20), F.slice(english, 1, 1)), F.concat(F.slice(english, -2, 2), F.slice(english, F.lit(1), F.greatest(F.size(english) - 2, F.lit(0)))))
    forms += [F.struct(_letters(F.array_join(x, "")).alias("key"), F.lit(False).alias("exact_only")) for x in turned]
    forms.append(F.struct(F.regexp_replace(telex(name), "[^a-z0-9]", "").alias("key"), F.lit(False).alias("exact_only")))
    short = _initials(F.concat_ws(" ", "h", "o"))
    forms.append(F.struct(F.concat(short, _letters(F.col("m"))).alias("key"), F.lit(True).alias("exact_only")))
    exploded = parts.select("code", F.col("m"), F.explode(F.array(*forms)).alias("f"))
    return exploded.select("f.key", "code", _letters(F.col("m")).alias("modifier"), "f.exact_only").filter("key != ''").distinct()


def drug_keys(reference: DataFrame) -> DataFrame:
    """(key, code, modifier, exact_only): names, and both orders of combinations."""
    pieces = F.split(F.col("name"), r"\s*/\s*")
    both = F.array(F.array_join(pieces, ""), F.array_join(F.reverse(pieces), ""))
    exploded = reference.select(F.col("rxcui").alias("code"), F.explode(both).alias("key"))
    return exploded.select(_letters(F.col("key")).alias("key"), "code", F.lit("").alias("modifier"), F.lit(False).alias("exact_only")).filter("key != ''").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def nearest_entries(values: DataFrame, keys: DataFrame, edits: int = 2) -> DataFrame:
    """(value, code, distance): the one nearest entry within ``edits`` of each value.

    ``values``: value, key, modifier (distinct values; a key may repeat). A value
    whose nearest entries are several has none.
    """
    rows = keys.count()
    usable = values.filter("key is not null and key != ''")
    agree = (F.col("v.modifier") == "") | (F.col("r.modifier") == "") | (F.col("v.modifier") == F.col("r.modifier"))
    exact = usable.alias("v").join(_small(keys, rows).alias("r"), (F.col("v.key") == F.col("r.key"))).select("v.value", "r.code", F.lit(0).alias("distance"))
    rest = usable.join(exact.select("value").distinct(), "value", "left_anti")

    n = F.length("key")
    fuzzy = keys.filter(f"not exact_only and length(key) > {edits}").withColumn("n", n)
    cut = fuzzy.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits)))).withColumn("j", F.col("i") + 1)
    segments = cut.select("key", "code", "modifier", "n", "i", F.expr("substring(key, cast(floor(n * i / {k}) as int) + 1, cast(floor(n * j / {k}) as int) - cast(floor(n * i / {k}) as int))".format(k=edits + 1)).alias("piece"))
    lengths = rest.withColumn("n", F.explode(F.sequence(F.length("key") - edits, F.length("key") + edits))).filter(f"n > {edits}")
    places = lengths.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits)))).withColumn("shift", F.explode(F.sequence(F.lit(-edits), F.lit(edits))))
    begin = f"cast(floor(n * i / {edits + 1}) as int) + shift"
    size = f"cast(floor(n * (i + 1) / {edits + 1}) as int) - cast(floor(n * i / {edits + 1}) as int)"
    pieces = places.filter(f"{begin} >= 0 and {begin} + {size} <= length(key)").select("value", "key", "modifier", "n", "i", F.expr(f"substring(key, {begin} + 1, {size})").alias("piece"))
    on = (F.col("v.n") == F.col("r.n")) & (F.col("v.i") == F.col("r.i")) & (F.col("v.piece") == F.col("r.piece")) & agree
    close = pieces.alias("v").join(_small(segments, rows * (edits + 1)).alias("r"), on)
    near = close.select("v.value", "r.code", F.levenshtein(F.col("v.key"), F.col("r.key"), edits).alias("distance")).filter("distance >= 0")
    every = exact.unionByName(near).groupBy("value", "code").agg(F.min("distance").alias("distance"))
    ranked = every.groupBy("value", "distance").agg(F.min("code").alias("code"), F.count("*").alias("ties"))
    first = ranked.groupBy("value").agg(F.min(F.struct("distance", "ties", "code")).alias("b"))
    return first.filter("b.ties = 1").select("value", "b.code", "b.distance")


def cut_short_entries(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(value, code): entries whose key alone begins with a value that was cut short (column ``stem``)."""
    rows = keys.count()
    stems = values.filter("stem != ''").select("value", "stem", F.substring("stem", 1, 5).alias("begin"))
    heads = keys.select("key", "code", F.substring("key", 1, 5).alias("begin"))
    found = stems.join(_small(heads, rows), "begin").filter("startswith(key, stem)")
    return found.groupBy("value").agg(F.min("code").alias("code"), F.count_distinct("code").alias("n")).filter("n = 1").select("value", "code")


def link(rows: DataFrame, text: str, kind: str, reference: DataFrame, edits: int | None = None) -> DataFrame:
    """Adds ``code`` (null where no entry is meant) to ``rows``; ``kind``: "drug" or "diagnosis"."""
    rules, keys = (DRUG_RULES, drug_keys(reference)) if kind == "drug" else (DIAGNOSIS_RULES, diagnosis_keys(reference))
    value = F.col(f"`{text}`")
    values = rows.select(value.alias("value")).filter("value is not null").distinct()
    folded = values.withColumn("_f", fold(F.col("value")))
    if kind == "drug":
        keyed = folded.select("value", apply_rules(F.col("_f"), rules).alias("key"), F.lit("").alias("modifier"))
        keyed = keyed.withColumn("stem", F.when(F.length("key") >= SHORTEST_STEM, F.col("key")).otherwise(""))
    else:
        marks = [_plain(m) for m in MODIFIERS]
        cleaned = folded.withColumn("key", apply_rules(F.col("_f"), rules))
        keyed = cleaned.select("value", "key", F.regexp_extract("key", "|".join(sorted(marks, key=len, reverse=True)), 0).alias("modifier"), F.lit("").alias("stem"))
    keyed = cut_lineage(keyed)  # read five times below
    matched = nearest_entries(keyed, keys, EDITS[kind] if edits is None else edits).select("value", "code")
    if kind == "drug":
        open_ = keyed.join(matched, "value", "left_anti")
        matched = matched.unionByName(cut_short_entries(open_, keys))
    return rows.join(matched.withColumnRenamed("value", "_v"), value == F.col("_v"), "left").drop("_v")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d")) if c.isascii() and c.isalnum())


def unmatched(rows: DataFrame, linked: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows that no entry is meant by."""
    return rows.join(linked.filter("code is not null").select(key), key, "left_anti")
