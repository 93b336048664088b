"""Text expressions: normal forms, tokens, similarity. All built-in, so they stay in generated code.

Null in, null out, unless said otherwise; an empty text has no tokens.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _accented() -> tuple[str, str]:
    """Every letter of the Latin, Greek and Cyrillic blocks that has marks, and its bare letter; the stroked d is a d."""
    pairs = {"đ": "d", "Đ": "D"}
    for o in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:]):
            pairs[chr(o)] = d[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BARE = _accented()
#: Runs of word characters and runs of others; together they give back the text.
SEGMENTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
WORDS = r"[\p{L}\p{N}_]+"


def fold(c: Column) -> Column:
    """Without accents on composed letters; as many characters as before."""
    return F.translate(c, ACCENTED, BARE)


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Accents composed with their letter. Only texts that hold a combining mark leave the JVM."""
    marked = c.rlike(r"\p{M}")
    return F.when(marked, _nfc(F.when(marked, c))).otherwise(c)


def strip_accents(c: Column) -> Column:
    """Without accents, composed or not."""
    return F.regexp_replace(fold(c), r"\p{M}+", "")


def ensure_text(c: Column) -> Column:
    """The value as a string, empty for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))


def strip_punctuation(c: Column) -> Column:
    """Brackets, quotes and separators as blanks, dashes as hyphens, blanks collapsed."""
    return squeeze(F.translate(F.regexp_replace(c, r"[\[\](){}\"'`,;:“”‘’]", " "), "–—−", "---"))


def composed_key(c: Column) -> Column:
    """``lookup_key`` of the composed form."""
    return lookup_key(nfc(c))


def bare_key(c: Column) -> Column:
    """The accent-insensitive key: ``lookup_key`` without accents, composed or not."""
    return lookup_key(strip_accents(c))


def code_key(c: Column) -> Column:
    return F.upper(F.trim(ensure_text(c)))


def dotless(c: Column) -> Column:
    return F.replace(code_key(c), F.lit("."), F.lit(""))


def key_tokens(key: Column) -> Column:
    """The tokens of a key; ``%``, ``+``, ``.``, ``/`` and ``-`` belong to tokens."""
    return F.filter(F.split(key, r"[^\p{L}\p{M}\p{N}_%+./\-]+"), lambda t: t != "")


def distinct_by_key(values: Column) -> Column:
    """The values of an array that are not blank, the first of those with an equal key, in order."""
    pairs = F.filter(F.transform(values, lambda v: F.struct(lookup_key(v).alias("k"), squeeze(v).alias("v"))), lambda p: p["k"] != "")
    return F.transform(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1), lambda p: p["v"])


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def retrieval_text(key: Column, bare: Column) -> Column:
    """The key, followed by its accentless form if that differs."""
    return F.when((bare != "") & (bare != key), F.concat_ws(" ", key, bare)).otherwise(key)


def retrieval_tokens(text: Column) -> Column:
    """Tokens of a retrieval text: amounts apart from their units, compound tokens followed by their parts."""
    apart = F.regexp_replace(text, r"(\d+(?:[.,]\d+)?)(mg|mcg|gm|g|ml|units|unit|%)(?=[^\p{L}\p{N}_]|$)", "$1 $2")
    whole = key_tokens(lookup_key(apart))
    parts = lambda t: F.when(t.rlike("[/-]"), F.filter(F.split(t, "[/-]+"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(whole, lambda t: F.concat(F.array(t), parts(t))))


VIETNAMESE_LETTERS = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
# Words that mark a text as Vietnamese.
VIETNAMESE_WORDS = ["benh", "bệnh", "viem", "viêm", "suy", "ung thư", "nhiễm", "tăng", "giảm"]


def alias_language(c: Column) -> Column:
    """vi by its letters or marker words, else en."""
    return F.when(F.lower(c).rlike(f"[{VIETNAMESE_LETTERS}]|{'|'.join(VIETNAMESE_WORDS)}"), "vi").otherwise("en")


def clip(c: Column) -> Column:
    """Into 0 to 1; NaN counts as 0."""
    return F.when(F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def alias_similarity(query: Column, alias: Column) -> Column:
    """0.8 times token F1 plus 0.2 times the ratio of the token counts, of two keys' blank-separated tokens; 0 without a common token."""
    q, a = (F.array_distinct(F.filter(F.split(x, " "), lambda t: t != "")) for x in (query, alias))
    return array_similarity(q, a)


def array_similarity(q: Column, a: Column) -> Column:
    common = F.size(F.array_intersect(q, a))
    ratio = F.least(F.size(q), F.size(a)) / F.greatest(F.size(q), F.size(a))
    return F.when(common == 0, 0.0).otherwise(clip(0.8 * (2.0 * common / (F.size(q) + F.size(a))) + 0.2 * ratio))


def lookup_key(c: Column) -> Column:
    """Lower case, brackets, quotes and separators as blanks, blanks collapsed, no blanks around / and -."""
    c = F.regexp_replace(F.lower(c), r"[\[\](){}\"'`,;:“”‘’]", " ")
    c = F.regexp_replace(c, r"[–—−]", "-")
    c = F.regexp_replace(c, r" *([/-]) *", "$1")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def words(c: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(c, F.lit(WORDS), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays as sets: 1 if both are empty, 0 if one is. Null arrays count as empty."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; 0 if either is empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def safe_divide(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_divide(2.0 * tp, 2 * tp + fp + fn)
