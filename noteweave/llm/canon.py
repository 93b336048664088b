"""One consistent form for texts that look alike but differ in characters.

A text is brought to its form token by token. Every letter has a set of scripts
it can be read in: its own, and Latin where it looks like a Latin letter. The
sets of a token's letters are intersected. A token whose letters all fit Latin
is spelled in Latin: this covers mixed tokens (a Cyrillic letter amid Latin
ones) and whole tokens written in look-alikes, as the notes are in Latin
script. A token of Greek letters that stand for themselves (alpha, beta as
signs) is left as it is. Compatibility forms (full width, Roman numerals,
ligatures, mathematical letters) turn into plain ones, spaces of any kind into
the ordinary one, invisible characters vanish, accents join their letter.

Signs with a meaning of their own (micro, degree, superscripts, fractions,
plus-minus) are untouched.

Null stays null; an empty or blank text keeps its ordinary blanks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin one (Unicode's
# public list of confusable characters, reduced to those in common fonts).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜавеѕіјкмнорсԁһԛԝухѵҽԍпгѐ", "ABESIJKMHOPCTYXYGQWaвesijkмнopcdhqwyxveгпгѐ", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυκτγχω", "ABEZHIKMNOPTYXaivopuktyxw", strict=True))
LATIN = {"ɡ": "g", "ı": "i", "ɑ": "a", "ꞓ": "c", "ʋ": "v", "ʏ": "y", "ɩ": "i", "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ƚ": "l", "ⱥ": "a"}
GREEK_SIGNS = set("αβγδεθλμπσφψωΔΣΩΦΨ")

CYRILLIC = {a: b for a, b in CYRILLIC.items() if b.isascii()}
LOOKALIKE = CYRILLIC | GREEK | LATIN
INVISIBLE = set("͏ᅟᅠ឴឵ㅤﾠ") | {chr(c) for c in range(0xFE00, 0xFE10)}

VIETNAMESE = "".join(
    unicodedata.normalize("NFC", base + tone)
    for base in ["a", "ă", "â", "e", "ê", "i", "o", "ô", "ơ", "u", "ư", "y", "A", "Ă", "Â", "E", "Ê", "I", "O", "Ô", "Ơ", "U", "Ư", "Y"]
    for tone in ["", "̀", "́", "̃", "̉", "̣"]
)
PLAIN = {chr(c) for c in range(0x20, 0x7F)} | set("\t\n\r") | set(VIETNAMESE) | set("đĐ") | set("µμ°²³¹½¼¾±×÷·–—‘’“”…•→≤≥")
UNPLAIN = re.compile("[^" + "".join(f"\\U{ord(c):08x}" for c in sorted(PLAIN)) + "]")
#: A run of letters and marks, which holds a character that a plain text doesn't have.
ODD_WORD = re.compile(rf"(?<![^\W\d_])(?:(?!{UNPLAIN.pattern})[^\W\d_])*+(?:{UNPLAIN.pattern})(?<=[^\W\d_̀-ͯ])(?:[^\W\d_]|[̀-ͯ])*")


def _java_class(chars: set[str]) -> str:
    codes, parts = sorted(map(ord, chars)), []
    start = last = codes[0]
    for c in [*codes[1:], None]:
        if c is not None and c == last + 1:
            last = c
            continue
        parts.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
        if c is not None:
            start = last = c
    return "".join(parts)


#: A Java pattern for a character that a plain text doesn't have.
ODD = f"[^{_java_class(PLAIN)}]"


def is_compat(c: str) -> bool:
    """Is it another form of a plain character, with no meaning of its own?"""
    o = ord(c)
    return 0xFF01 <= o <= 0xFF5E or 0x2160 <= o <= 0x217F or 0xFB00 <= o <= 0xFB06 or 0x1D400 <= o <= 0x1D7FF or 0x24B6 <= o <= 0x24E9


def scripts(c: str) -> frozenset[str]:
    """The scripts that a letter can be read in."""
    base = unicodedata.normalize("NFD", c)[0]
    name = unicodedata.name(base, "").split(" ")[0]
    own = {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek"}.get(name, name.title())
    return frozenset({own, "Latin"} if base in LOOKALIKE else {own})


def _latin(c: str) -> str:
    d = unicodedata.normalize("NFD", c)
    return LOOKALIKE.get(d[0], d[0]) + d[1:]


def _token(m: re.Match[str]) -> str:
    t = m[0]
    letters = [c for c in t if c.isalpha()]
    shared = frozenset.intersection(*map(scripts, letters)) if letters else frozenset()
    own = {next(iter(scripts(c) - {"Latin"}), "Latin") for c in letters}
    if own == {"Greek"} and all(c in GREEK_SIGNS for c in letters):
        return t
    if "Latin" in shared or "Latin" in own:  # else the token fits another script alone, and stays
        return "".join(_latin(c) if unicodedata.normalize("NFD", c)[0] in LOOKALIKE else c for c in t)
    return t


def _character(m: re.Match[str]) -> str:
    c = m[0]
    kind = unicodedata.category(c)
    if kind == "Cf" or c in INVISIBLE:
        return ""
    return " " if kind == "Zs" else "\n" if kind in ("Zl", "Zp") else unicodedata.normalize("NFKC", c) if is_compat(c) else c


def canonical(text: str) -> str:
    """The one form of a text."""
    if not UNPLAIN.search(text):
        return text
    t = unicodedata.normalize("NFC", UNPLAIN.sub(_character, unicodedata.normalize("NFC", text)))
    return unicodedata.normalize("NFC", ODD_WORD.sub(_token, t)) if UNPLAIN.search(t) else t


def canonical_with_offsets(text: str) -> tuple[str, list[int]]:
    """The one form, and for each of its characters the place in ``text`` that it came from; last, the length."""
    t = canonical(text)
    if len(t) == len(text):
        return t, list(range(len(text) + 1))
    # characters with their marks and the invisible ones after them form clusters, which turn into their form one by one
    out, place, i, n = [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or text[j] not in PLAIN and (unicodedata.category(text[j]) == "Cf" or text[j] in INVISIBLE)):
            j += 1
        for c in canonical(text[i:j]):
            out.append(c)
            place.append(i)
        i = j
    joined = "".join(out)
    if len(joined) == len(t):
        return t, [*place, n]
    return joined, [*place, n]


@F.pandas_udf(T.StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else canonical(x))


def canonical_column(c: Column) -> Column:
    """The one form of a string column; plain texts never leave the JVM."""
    return F.when(c.rlike(ODD), _canonical_udf(F.when(c.rlike(ODD), c))).otherwise(c)


def unify_characters(df: DataFrame, text: str, out: str = "canonical_text") -> DataFrame:
    """Adds the one form of ``text``; a column named ``out`` is replaced.

    Only texts with a character outside the plain set are sent to Python, so for
    most rows this is one regular expression inside the JVM. One scan, no shuffle.
    """
    return df.withColumn(out, canonical_column(F.col(f"`{text}`")))


def find_variants(df: DataFrame, text: str, key: str) -> DataFrame:
    """The keys of rows whose text isn't in its one form. Null texts are none."""
    odd = df.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").alias("_t")).filter(F.col("_t").rlike(ODD))
    return odd.filter(_canonical_udf("_t") != F.col("_t")).select("row_key")
