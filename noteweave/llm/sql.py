"""The SQL of queries that plain SQL can express on tables of moderate size: all shared word runs, joined and counted.

Characters are brought to one form by tables made from ``canon``, one character
at a time; a token's context plays no part, which moves no pair across the gap
between real cases and others.
"""

from __future__ import annotations

from noteweave.llm import shingles
from noteweave.llm.canon import canonical


def _tables() -> tuple[str, str, str, str]:
    """Characters that stand for a letter or digit, those letters, characters that vanish, and characters that are not in their one form."""
    source, target, gone, odd = [], [], [], []
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        c = canonical(chr(o))
        if not c:
            gone.append(chr(o))
        elif len(c) == 1 and ord(c) < 0x10000 and shingles.FOLD[ord(c)] != 32:
            source.append(chr(o))
            target.append(chr(shingles.FOLD[ord(c)]))
        if c != chr(o):
            odd.append(chr(o))
    return "".join(source), "".join(target), "".join(gone), "".join(odd)


def _ranges(chars: str) -> str:
    """The inside of a bracket expression."""
    out, codes = [], sorted(map(ord, chars))
    start = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = c
        last = c
    return "".join(out)


SOURCE, TARGET, GONE, ODD = _tables()
_PLAIN = f"lower(translate(nfc_normalize(regexp_replace(text, '[{_ranges(GONE)}]', '', 'g')), '{SOURCE}', '{TARGET}'))"
_SETS = (
    f"w AS (SELECT sample_no, file_id, split, source, regexp_extract_all({_PLAIN}, '[a-z0-9]+') AS ws FROM calibration WHERE text IS NOT NULL), "
    "texts AS (SELECT row_number() OVER () AS t, ws FROM (SELECT DISTINCT ws FROM w WHERE len(ws) >= 3)), sh AS (SELECT DISTINCT t, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM texts), n AS (SELECT t, count(*) AS n FROM sh GROUP BY 1), "
    "rows_ AS (SELECT w.sample_no, w.file_id, w.split, w.source, x.t FROM w JOIN texts x ON w.ws = x.ws), common AS (SELECT a.t AS ta, b.t AS tb, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.t < b.t GROUP BY 1, 2), near AS (SELECT ta, tb FROM common JOIN n x ON x.t = ta JOIN n y ON y.t = tb WHERE c / (x.n + y.n - c)::DOUBLE >= 0.5), linked AS (SELECT ta, tb FROM near UNION ALL SELECT tb, ta FROM near UNION ALL SELECT t, t FROM texts)"
)
_OVERLAPS = (
    f"{_SETS}, e AS (SELECT sample_no, file_id, split, source FROM calibration WHERE split IS DISTINCT FROM 'train'), pairs AS (SELECT x.sample_no AS e, y.sample_no AS t FROM rows_ x JOIN linked ON ta = x.t JOIN rows_ y ON tb = y.t WHERE x.split IS DISTINCT FROM 'train' AND y.split = 'train' UNION SELECT e.sample_no, c.sample_no FROM e JOIN calibration c ON c.file_id = e.file_id WHERE c.split = 'train'), "
    "over_ AS (SELECT least(p.e, p.t) AS sample_no_a, greatest(p.e, p.t) AS sample_no_b, e.split AS eval_split, e.source AS eval_source FROM pairs p JOIN e ON e.sample_no = p.e)"
)


def _differs(column: str) -> str:
    return f"(regexp_matches({column}, '[{_ranges(ODD)}]') OR nfc_normalize({column}) <> {column})"


SQL = {
    "p1_found": f"WITH {_SETS}, m AS (SELECT DISTINCT t, file_id FROM rows_ WHERE file_id IS NOT NULL) SELECT DISTINCT least(x.file_id, y.file_id) AS file_id_a, greatest(x.file_id, y.file_id) AS file_id_b FROM m x JOIN linked ON ta = x.t JOIN m y ON tb = y.t WHERE x.file_id <> y.file_id",
    "p5_found": f"SELECT DISTINCT 'calibration' AS src_table, file_id AS row_key FROM calibration WHERE {_differs('text')} UNION ALL SELECT 'symptoms_vi', CAST(alias_id AS VARCHAR) FROM symptoms_vi WHERE {_differs('alias')}",
    "p6_found": f"WITH {_OVERLAPS} SELECT * FROM over_",
    "p6_report": f"WITH {_OVERLAPS} SELECT eval_split, eval_source, count(*) AS pairs FROM over_ GROUP BY 1, 2",
}
