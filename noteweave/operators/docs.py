"""Texts cut into lines, tokens, chunks, sections and windows, with exact offsets in code points.

Offsets are found in one pass over each text, so nothing here is exchanged to
find out where a token or line stands. Null texts have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import bare_key, composed_key, fold, lookup_key

#: Cells of output gathered before a batch is handed on.
ROWS = 1 << 15


def per_text(df: DataFrame, id: str, text: str, columns: list[tuple[str, pa.DataType]], cut: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """(id, *columns): the rows that ``cut`` gives for each text, streamed in batches of bounded size."""
    kind = df.schema[id].dataType.simpleString()
    names = [n for n, _ in columns]
    shown = {pa.int32(): "int", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
            return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True))], names=["id", *names])

        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(b.column("text").to_pylist()):
                for r in cut(t):
                    at.append(i)
                    rows.append(r)
                    if len(rows) >= ROWS:
                        yield batch()
                        at, rows = [], []
            yield batch()

    named = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    return named.mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} {shown[t]}" for n, t in columns)]))


_WORD = re.compile(r"\w+")
_LINE_END = re.compile(r"\r\n|\n|\r")


def tokens(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, pos, token, start_pos, end_pos, key) per word; offsets are 0-based, end-exclusive. ``key`` is lower case without accents. No exchange."""

    def cut(t: str) -> Iterator[tuple]:
        return ((i, m[0], m.start(), m.end()) for i, m in enumerate(_WORD.finditer(t)))

    d = per_text(df, id, text, [("pos", pa.int32()), ("token", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())], cut)
    return d.withColumn("key", fold(F.lower("token")))


def lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line_no, line, start_pos, end_pos); a line ends at CR LF, LF or CR. An empty text has one empty line. No exchange."""

    def cut(t: str) -> Iterator[tuple]:
        at = no = 0
        for m in _LINE_END.finditer(t):
            yield no, t[at : m.start()], at, m.start()
            at, no = m.end(), no + 1
        yield no, t[at:], at, len(t)

    return per_text(df, id, text, [("line_no", pa.int32()), ("line", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())], cut)


# What begins a list item, by level.
BULLETS = [r"^\s*[-*•]\s+", r"^\s*\d+[.)]\s+", r"^\s*[a-zA-Z][.)]\s+"]
MARKER = r"^\s*(?:[-*•]+\s*|(?:\d+|[ivxlcdmIVXLCDM]+|[a-zA-Z])[.)]\s+)"


def bullet_level(line: Column) -> Column:
    """The number of the first pattern of list items that a line begins with; null for none."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(BULLETS, 1))):
        out = F.when(line.rlike(p), i).otherwise(out)
    return out


def _cut(text: str, most: int, least: float) -> Iterator[tuple[int, int]]:
    at = 0
    while len(text) - at > most:
        part, low = text[at : at + most], int(most * least)
        stop = max(part.rfind(c) for c in ".!?;:") + 1
        if stop < low or not stop:
            stop = next((i for i in range(most - 1, low - 1, -1) if part[i].isspace()), 0) or most
        a, b = at, at + stop
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        if a < b:
            yield a, b
        at += stop
        while at < len(text) and text[at].isspace():
            at += 1
    if at < len(text):
        yield at, len(text)


def chunks(df: DataFrame, id: str, text: str, most: int = 500, least: float = 0.4) -> DataFrame:
    """(id, chunk_no, line_no, start_pos, end_pos, chunk): lines without white space at their ends, blank ones left out.

    A line longer than ``most`` is cut after the last sentence mark that is at
    least ``least`` of the way, else at the last white space that is, else hard.
    """

    def cut(t: str) -> Iterator[tuple]:
        no = at = line = 0
        for end in [*((m.start(), m.end()) for m in _LINE_END.finditer(t)), (len(t), len(t))]:
            s = t[at : end[0]]
            left = len(s) - len(s.lstrip())
            for a, b in _cut(s.strip(), most, least):
                yield no, line, at + left + a, at + left + b, s[left + a : left + b]
                no += 1
            at, line = end[1], line + 1

    return per_text(df, id, text, [("chunk_no", pa.int32()), ("line_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("chunk", pa.string())], cut)


def sections(lined: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """Adds ``section``: the label of the last heading at or before each line; null before the first.

    ``labels``: (label, pattern on the folded lower-case line), first match wins.
    """
    key = fold(F.lower("line"))
    found = F.lit(None).cast("string")
    for label, pattern in reversed(labels):
        found = F.when(key.rlike(pattern), label).otherwise(found)
    d = lined.withColumn("_label", found)
    carried = F.last("_label", ignorenulls=True).over(W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("section", carried).drop("_label")


def heading_like(text: Column, most: int = 160) -> Column:
    """Could a chunk be a heading: a list marker, an early colon, short capitals, or ten words at most?"""
    t = F.trim(text)
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    colon = F.position(F.lit(":"), t)
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (n <= 12)
    return (t != "") & (F.length(t) <= most) & (t.rlike(MARKER) | ((colon > 0) & (colon <= 81)) | capitals | (n <= 10))


def subsection_like(text: Column) -> Column:
    """Is a chunk short, with a colon or a list marker?"""
    t = F.trim(text)
    return (t != "") & (F.length(t) <= 120) & (F.contains(t, F.lit(":")) | t.rlike(MARKER))


def _unmarked(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, MARKER, ""))


def _begins(text: Column, pattern: Column) -> Column:
    return (pattern != "") & (F.startswith(text, pattern) | F.startswith(F.trim(F.split(text, ":", 2)[0]), pattern))


def heading_matches(chunked: DataFrame, patterns: DataFrame, most: int = 160, prefix: int = 80) -> DataFrame:
    """(id, chunk_no, label, confidence, how): the best section pattern of each chunk that has one.

    Three passes: the whole chunk is a pattern (1.0, without accents 0.9); what
    stands before its first colon is or begins with one (0.82, without accents
    0.72); the chunk begins with one (0.78 if like a heading, without accents
    0.72). The earliest pass wins, then confidence, then the pattern's place.
    ``patterns``: (label, ord, pattern), a configuration table of some hundred rows.
    """
    p = patterns.select("label", "ord", _unmarked(composed_key(F.col("pattern"))).alias("p"), _unmarked(bare_key(F.col("pattern"))).alias("pb")).filter("p != ''")
    d = chunked.select("id", "chunk_no", "chunk").withColumns({
        "k": _unmarked(composed_key(F.col("chunk"))), "kb": _unmarked(bare_key(F.col("chunk"))), "short": F.length(F.trim("chunk")) <= most, "like": heading_like(F.col("chunk"), most),
        "pre": F.when(F.contains("chunk", F.lit(":")), F.substring(F.split("chunk", ":", 2)[0], 1, prefix)),
    })
    d = d.withColumn("pk", _unmarked(composed_key(F.col("pre")))).withColumn("pb_", _unmarked(bare_key(F.col("pre")))).drop("pre", "chunk")
    # patterns are a small list beside the rows: a fixed set of first letters decides which a chunk can meet
    first = F.array_distinct(F.filter(F.array(F.substring("k", 1, 1), F.substring("kb", 1, 1), F.substring("pk", 1, 1), F.substring("pb_", 1, 1)), lambda x: x != ""))
    left = d.withColumn("f", F.explode(first))
    right = p.withColumn("f", F.explode(F.array_distinct(F.array(F.substring("p", 1, 1), F.substring("pb", 1, 1)))))
    j = left.join(right, "f")
    c = lambda when, n, conf, how: F.when(when, F.struct(F.lit(-n).alias("pass"), F.lit(conf).alias("confidence"), F.lit(how).alias("how")))
    best = F.coalesce(
        c(F.col("k") == F.col("p"), 1, 1.0, "exact_heading"), c(F.col("kb") == F.col("pb"), 1, 0.9, "exact_no_diacritics_heading"),
        c(F.col("pk") == F.col("p"), 2, 1.0, "exact_inline"), c(F.col("pb_") == F.col("pb"), 2, 0.9, "exact_no_diacritics_inline"),
        c(_begins(F.col("pk"), F.col("p")), 2, 0.82, "containment_inline"), c(_begins(F.col("pb_"), F.col("pb")), 2, 0.72, "containment_no_diacritics_inline"),
        c(F.col("like") & _begins(F.col("k"), F.col("p")), 3, 0.78, "containment_heading"), c(F.col("short") & _begins(F.col("kb"), F.col("pb")), 3, 0.72, "containment_no_diacritics_heading"),
    )
    m = j.withColumn("m", best).filter("m is not null").groupBy("id", "chunk_no").agg(F.max(F.struct("m.pass", "m.confidence", (-F.col("ord")).alias("o"), "label", "m.how")).alias("b"))
    return m.select("id", "chunk_no", "b.label", "b.confidence", "b.how")


def detect_sections(chunked: DataFrame, patterns: DataFrame, least: float = 0.55, carried: float = 0.30, default: str = "UNKNOWN") -> DataFrame:
    """Adds ``section``, ``section_confidence``, ``section_source`` and ``subsection`` to chunks; labels are carried forward."""
    m = heading_matches(chunked, patterns).filter(F.col("confidence") >= least)
    d = chunked.join(m, ["id", "chunk_no"], "left")
    w = W.partitionBy("id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("label").isNotNull(), F.struct("label", "confidence")), ignorenulls=True).over(w)
    d = d.withColumn("_l", last)
    carry = F.col("_l").isNotNull() & (F.col("_l.label") != default)
    d = d.withColumn("section", F.coalesce("label", F.when(carry, F.col("_l.label")), F.lit(default)))
    d = d.withColumn("section_confidence", F.coalesce("confidence", F.when(carry, F.least(F.col("_l.confidence"), F.lit(carried))), F.lit(0.0)))
    d = d.withColumn("section_source", F.coalesce("how", F.when(carry, "carry_forward"), F.lit("default")))
    return d.withColumn("subsection", F.when(subsection_like(F.col("chunk")), lookup_key(F.col("chunk")))).drop("label", "confidence", "how", "_l")


def parent_units(chunked: DataFrame, by: str) -> DataFrame:
    """(id, unit_no, start_pos, end_pos, n_chunks): runs of neighbouring chunks with equal ``by`` (a line number, a section)."""
    w = W.partitionBy("id").orderBy("chunk_no")
    begins = (~F.lag(by).over(w).eqNullSafe(F.col(by))) | (F.row_number().over(w) == 1)
    d = chunked.withColumn("_u", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return d.groupBy("id", F.col("_u").cast("int").alias("unit_no")).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n_chunks"))


def token_windows(df: DataFrame, id: str, text: str, size: int, overlap: int) -> DataFrame:
    """(id, window_no, first_token, last_token, start_pos, end_pos); the last window reaches the end, none is only overlap. No exchange."""
    step = size - overlap

    def cut(t: str) -> Iterator[tuple]:
        at = [m.span() for m in _WORD.finditer(t)]
        for no in range(max(1, -(-(len(at) - overlap) // step)) if at else 0):
            a, b = no * step, min(no * step + size, len(at))
            yield no, a, b - 1, at[a][0], at[b - 1][1]

    return per_text(df, id, text, [(n, pa.int32()) for n in ("window_no", "first_token", "last_token", "start_pos", "end_pos")], cut)
