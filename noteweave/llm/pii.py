"""Personal data in free text: found, scored and replaced by typed placeholders.

Patterns propose spans on a folded copy of the text (one form of characters, no
accents, lower case), so full-width digits, invisible characters, missing
accents and capitals make no difference; every offset is carried back to the
text as stored. Each proposal has a score: its own form, what validators say
(Luhn for card-like numbers, mod-97 for account-like ones, lengths and leading
digits for phones and identity numbers), and context words before and after it,
which raise or lower it. Proposals of ``ACCEPT`` or more stay; where two overlap
the earlier kind in ``KINDS`` wins.

Place and name lexicons are constants of this module. A name or place outside them is still
found where its form and context are clear.

Null, empty and blank texts hold no personal data; a null stays null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.llm.canon import UNPLAIN, canonical_with_offsets

KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")
ACCEPT = 0.6

# Common Vietnamese family names, given names, and (without accents) the place names of the notes.
SURNAMES = """nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đào đoàn vương trịnh trương đinh lâm phùng tô tạ
lương châu tăng thái quách mạc kiều khúc nghiêm ninh""".split()
GIVEN = """dao bách hằng châu trạch lam vy quyên sơn thư nhiên khoa đạt duật mộc tịnh yên kỳ khuê vĩ diệp lộc hạc phiên giao lạc vịnh
huyền cẩn mẫn uyên sương trúc thuỵ nhược khải đăng lâm hải""".split()
PLACES = """hoa gao;vuon quyt;doi sim;gieng da;ben lau;tho nhuom cu;cau may;lo gom;song vang;ho sen tim;phu sa;my lac;tan linh;vinh tram;
an khe ha;thuong van;dong giai;hoa dien;lam hai;nam yen;bac trach;long vi;tay ha;cam son dong;binh khe;hai lam;van giang;dong sa"""
PLACES = [" ".join(x.split()) for x in PLACES.split(";")]


def _fold_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for o in [*range(65, 91), *range(0xC0, 0x1EFF)]:
        c = chr(o).lower().replace("đ", "d")
        d = unicodedata.normalize("NFD", c)
        if len(c) == 1 and d[0].isascii():
            table[o] = ord(d[0])
    return table


FOLDED = _fold_table()


def fold(text: str) -> str:
    """Lower case without accents; as many characters as before."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x10000, FOLDED[codes & 0xFFFF], codes).tobytes().decode("utf-32-le", "surrogatepass")


def luhn(digits: str) -> bool:
    """Does a number pass the Luhn check?"""
    total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Does an account number (two letters, two check digits, the rest) pass the mod-97 check?"""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


EMAIL = re.compile(r"(?<![a-z0-9._+\-])[a-z0-9][a-z0-9._+\-]*\s?(?:@|[(\[]\s?at\s?[)\]])\s?[a-z0-9\-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[a-z0-9\-]+)+")
LONG_NUMBER = re.compile(r"\d(?:[ .\-()]{0,2}\d){8}|[a-z]{2}\d\d ?[a-z0-9]{4} ?[a-z0-9]{4}")
PHONE = re.compile(r"(?<![\w+/])(?<!\d[.,\-])(?:\(\+84\)[ .\-]?\d(?:[ .\-]?\d){8}|\+84[ .\-]?\d(?:[ .\-]?\d){8}|\(0\d\d\)[ .\-]?\d(?:[ .\-]?\d){6}|0\d(?:[ .\-]?\d){8})(?![\d/]|[.\-]\d)")
PHONE_CUE = re.compile(r"(?:dien thoai|sdt|dt|goi|lien he|tong dai|reached on|phone|tel|so may|roi|lai|hotline|zalo)\W*$")
INSURANCE = re.compile(r"(?<!\w)[a-z]{2} ?\d(?: ?\d){12}(?!\w)")
NUMBER = re.compile(r"(?<![\w.,\-/+])(?:\d(?: ?\d){15}|\d(?: ?\d){11}|\d(?: ?\d){8})(?![\w/]|[.,\-]\d)")
ACCOUNT = re.compile(r"(?<!\w)[a-z]{2}\d\d(?: ?[a-z0-9]{4}){3,7}(?: ?[a-z0-9]{1,3})?(?!\w)")
ID_CUE = re.compile(r"(?:dinh danh|can cuoc|cccd|cmnd(?: cu)?|chung minh|ho chieu|bao hiem(?: mang ma| so)?|bhyt|card number|khai nham so|doc lai cho ro|passport|the)\W*(?:so|ma|la)?\W*$")
NOT_PERSONAL = re.compile(r"(?:benh pham|lo thuoc|lo|may tho ma|may tho|thiet bi|chi dinh so|chi dinh|phieu(?: so)?|phim so|phim|ma mau|ma vach|seri|serial|batch|lot|hop so|bien lai)\W*(?:so|ma)?\W*$")

NUM = r"\d{1,4}(?:bis\b|[a-z]\d{0,2}\b)?(?:/\d{1,4}[a-z]?\b)?"
HEAD = re.compile(rf"(?<![\w/.,\-])(?:(?:(?:so nha|so|nha|can ho|can|thon|ap|khom) )(?:so )?{NUM}|{NUM}(?= ))")
AREA = re.compile(r"(?<![a-z])(?:phuong|xa|quan|huyen|tinh|thanh pho|thi xa|thi tran|tp|tx|duong|pho|chung cu|p\.|q\.|ngo)[ .]")
LANE = re.compile(rf" ?,? (?:ngo|ngach|hem|kiet) {NUM}")
STREET = re.compile(r" ?,? (?:duong|pho|chung cu|dai lo|khu tap the) ")
PART = re.compile(r" ?, ?(?:phuong|xa|thi tran|quan|huyen|thi xa|tinh|thanh pho|tp\.?|tx\.?|p\.|q\.|h\.|t\.) ?")
PLACE = re.compile(rf"(?:{'|'.join(sorted(PLACES, key=len, reverse=True))})(?![a-z])")
WORD_AT = re.compile(r"[^\W\d_]+")

ACCENTED = {fold(x): set() for x in SURNAMES + GIVEN}
for _x in SURNAMES + GIVEN:
    ACCENTED[fold(_x)].add(_x)
SURNAME = "|".join(map(fold, SURNAMES))
NAME = re.compile(rf"(?<![\w\-@.+])(?<!giam )(?:{SURNAME})(?: (?:{'|'.join(map(fold, GIVEN))})(?! nham\b)){{1,3}}(?![\w@]|[.\-_+]\w)")
WEAK_CUE = re.compile(r"(?<![a-z])(?:va|thi|theo|cua|chi|anh|em|be|co|ba|ong|chu|bac|chau|(?<!ho )ten)\W*$")
BEFORE = r"(?:ho ten|ho va ten|benh nhan|bn|nguoi nha|nguoi nhan|giam ho|ten|dem qua|hom qua|theo|chi|anh|ong|ba|co|chu|bac|em|be|chau|ghi|gap|cua|va|thi|bac si|bs|dieu duong|patient|mr|mrs|ms)"
NAME_CUE = re.compile(rf"(?<![a-z]){BEFORE}\W*$")
NAME_AFTER = re.compile(r"\W*(?:da kham|co goi|trinh bay|la nguoi|xin ve|khai nham|thay nhau|lives|ky giay|di cung|va |\()")
LOOSE_NAME = re.compile(rf"(?<![a-z])(?:ho ten|benh nhan|bn|nguoi nha|nguoi nhan|giam ho|dem qua|hom qua|tay ghi|lai ghi|thi gap|me cua|la chi|hoi ky thi|patient)[: ]+((?:{SURNAME}) [a-z]+(?: [a-z]+){{0,2}})")
NOT_NAME = re.compile(r"(?:phuong|xa|quan|huyen|tinh|thanh pho|tp\.?|p\.|q\.|h\.|duong|pho|chung cu|nghiem phap|thang diem|khoa|hoi chung|test|phong kham|benh vien)\W*$")


def _near(a: str, b: str) -> bool:
    """Are two words at most one edit apart?"""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _place_end(t: str, f: str, at: int) -> int | None:
    """Where the place name that begins at ``at`` ends."""
    m = PLACE.match(f, at)
    if m:
        return m.end()
    ends, p = [], at
    while len(ends) < 4 and (w := WORD_AT.match(t, p)):
        ends.append(w.end())
        p = w.end() + 1 if t[w.end() : w.end() + 1] == " " else len(t) + 1
    for e in reversed(ends):
        if any(_near(f[at:e], x) for x in PLACES):
            return e
    run = 0
    while run < min(3, len(ends)) and t[(ends[run - 1] + 1) if run else at].isupper():
        run += 1
    return ends[run - 1] if run else None


def _addresses(t: str, f: str) -> Iterator[Span]:
    done = 0
    if not AREA.search(f):
        return
    for m in HEAD.finditer(f):
        if m.start() < done:
            continue
        worded = not f[m.start()].isdigit()
        p, end, parts = m.end(), None, 0
        if lane := LANE.match(f, p):
            p = lane.end()
        street = STREET.match(f, p)
        if street:
            end = _place_end(t, f, street.end())
        elif not worded and f[p : p + 1] == " ":
            end = _place_end(t, f, p + 1)
        elif worded and lane:
            end = p
        else:
            end = p if worded else None
        if end is None:
            continue
        while part := PART.match(f, end):
            e = _place_end(t, f, part.end())
            if e is None:
                break
            end, parts = e, parts + 1
        score = 0.3 * bool(street) + 0.3 * min(parts, 2) + 0.1 * worded + 0.2 * bool(PLACE.search(f, p, end))
        if score >= ACCEPT:
            done = end
            yield Span("ADDRESS", m.start(), end, min(score, 1.0))


def _numbers(f: str) -> Iterator[Span]:
    for m in PHONE.finditer(f):
        before = f[max(0, m.start() - 30) : m.start()]
        score = 0.7 + 0.2 * bool(PHONE_CUE.search(before)) - 0.5 * bool(NOT_PERSONAL.search(before))
        yield Span("PHONE", m.start(), m.end(), score)
    for m in INSURANCE.finditer(f):
        before = f[max(0, m.start() - 30) : m.start()]
        yield Span("ID", m.start(), m.end(), 0.8 + 0.2 * bool(ID_CUE.search(before)) - 0.5 * bool(NOT_PERSONAL.search(before)))
    for m in NUMBER.finditer(f):
        digits = m[0].replace(" ", "")
        before = f[max(0, m.start() - 30) : m.start()]
        form = 0.4 + 0.2 * (digits[0] == "9") if len(digits) < 16 else 0.2 + 0.4 * luhn(digits)
        yield Span("ID", m.start(), m.end(), form + 0.4 * bool(ID_CUE.search(before)) - 0.5 * bool(NOT_PERSONAL.search(before)))
    for m in ACCOUNT.finditer(f):
        code = m[0].replace(" ", "")
        if any(c.isdigit() for c in code[4:]) and mod97(code):
            yield Span("ID", m.start(), m.end(), 0.9)


def _shape(word: str) -> str:
    return "upper" if len(word) > 1 and word.isupper() else "title" if word[:1].isupper() else "lower"


def _names(t: str, f: str) -> Iterator[Span]:
    found = []
    for m in NAME.finditer(f):
        before = f[max(0, m.start() - 24) : m.start()]
        words = t[m.start() : m.end()].split(" ")
        shape = _shape(words[0])
        n = 1
        while n < len(words) and _shape(words[n]) == shape:
            n += 1
        words = words[:n]
        low = [w.lower() for w in words]
        bare = all(x.isascii() for x in low)
        if n < 2 or not bare and not all(x in ACCENTED[fold(x)] for x in low):
            continue
        end = m.start() + len(" ".join(words))
        around = [w for w in t[max(0, m.start() - 24) : m.start()].split()[1:] + t[end : end + 24].split()[:1] if len(w) > 2 and w.isalpha()]
        loud = shape == "upper" and bool(around) and around[-1].isupper()
        form = 0.7 if shape == "title" or shape == "upper" and not loud else 0.3 if not bare else 0.1
        cue = 0.5 if NAME_CUE.search(before) and not (bare and form < 0.7 and WEAK_CUE.search(before)) or NAME_AFTER.match(f, end) else 0.0
        score = form + cue - 0.6 * bool(NOT_NAME.search(before))
        if score >= ACCEPT:
            found.append((m.start(), end))
            yield Span("NAME", m.start(), end, min(score, 1.0))
    for m in LOOSE_NAME.finditer(f):
        a, words = m.start(1), t[m.start(1) : m.end(1)].split(" ")
        if any(x < m.end(1) and a < y for x, y in found):
            continue
        n = 1
        while n < len(words) and words[n][:1].isupper() and (not words[n].isupper() or n < 3):
            n += 1
        if words[0][:1].isupper() and n > 1:
            yield Span("NAME", a, a + len(" ".join(words[:n])), 0.65)


def find(text: str) -> list[Span]:
    """The personal data of a text, in order, with offsets into the text as stored."""
    t, place = canonical_with_offsets(text) if UNPLAIN.search(text) else (text, None)
    f = fold(t)
    proposals: list[Span] = []
    if "@" in f or "at)" in f or "at]" in f:
        proposals += [Span("EMAIL", *m.span(), 0.95) for m in EMAIL.finditer(f)]
    proposals += _addresses(t, f)
    if LONG_NUMBER.search(f):
        proposals += _numbers(f)
    proposals += _names(t, f)
    kept: list[Span] = []
    for s in sorted((s for s in proposals if s.score >= ACCEPT), key=lambda s: (KINDS.index(s.kind), -s.score, s.start)):
        if all(s.end <= k.start or k.end <= s.start for k in kept):
            kept.append(s)
    out = []
    for s in sorted(kept, key=lambda s: s.start):
        a, b = (s.start, s.end) if place is None else (place[s.start], place[s.end])
        while b > a and (text[b - 1].isspace() or unicodedata.category(text[b - 1]) == "Cf"):
            b -= 1
        out.append(Span(s.kind, a, b, s.score))
    return out


def redact(text: str) -> str:
    """The text with ``[KIND]`` in place of each piece of personal data; all else unchanged."""
    out, at = [], 0
    for s in find(text):
        out += [text[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, kind, start, end, score = [], [], [], [], []
        keys = b.column("key")
        for i, t in enumerate(b.column("text").to_pylist()):
            for s in find(t) if t else ():
                key.append(i)
                kind.append(s.kind)
                start.append(s.start)
                end.append(s.end)
                score.append(s.score)
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(key, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64())],
            names=["key", "pii_kind", "start_pos", "end_pos", "score"],
        )


def find_personal_data(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row (key, pii_kind, start_pos, end_pos, score) per piece of personal data. One pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    named = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    return named.mapInArrow(_rows, f"key {kind}, pii_kind string, start_pos long, end_pos long, score double")


@F.pandas_udf(T.StringType())
def _redact_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else redact(x))


def redact_personal_data(df: DataFrame, text: str, out: str = "redacted_text") -> DataFrame:
    """Adds the text with typed placeholders; a column named ``out`` is replaced."""
    return df.withColumn(out, _redact_udf(F.col(f"`{text}`")))
