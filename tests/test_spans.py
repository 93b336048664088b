import time

from noteweave.functions import text as tx
from noteweave.operators import docs, fusion, greedy, scoring, spans
from pyspark.sql import functions as F

SPAN = "id long, start_pos int, end_pos int, entity_type string"


def make(spark, rows, shape=SPAN):
    return spark.createDataFrame(rows, shape)


def test_tokens_give_back_the_text(spark):
    texts = ["Đau đầu, sốt 38°C", "", "một", None, "áb c", "x" * 5000 + " y"]
    df = make(spark, list(enumerate(texts)), "k long, text string")
    rows = docs.tokens(df, "k", "text").collect()
    assert {r.id for r in rows} == {0, 2, 4, 5}
    for r in rows:
        assert texts[r.id][r.start_pos : r.end_pos] == r.token


def test_lines_bullets_sections(spark):
    df = make(spark, [(1, "Tiền sử:\r\n- a\n  - b\nKế hoạch: c"), (2, ""), (3, None)], "k long, text string")
    rows = docs.lines(df, "k", "text").withColumn("b", docs.bullet_level(F.col("line"))).orderBy("id", "line_no").collect()
    assert [(r.id, r.line, r.start_pos, r.b) for r in rows] == [(1, "Tiền sử:", 0, None), (1, "- a", 10, 1), (1, "  - b", 14, 1), (1, "Kế hoạch: c", 20, None), (2, "", 0, None)]  # a level is the number of the pattern, whatever the indent
    lab = docs.sections(docs.lines(df, "k", "text"), [("h", "^tien su"), ("p", "^ke hoach")]).filter("id = 1").orderBy("line_no").collect()
    assert [r.section for r in lab] == ["h", "h", "h", "p"]


def test_chunks_cover_the_text(spark):
    text = "Câu một. " * 200 + "\n\n" + "x" * 1300
    df = make(spark, [(1, text), (2, ""), (3, None)], "k long, text string")
    rows = docs.chunks(df, "k", "text", 500).collect()
    assert {r.id for r in rows} == {1}
    assert all(text[r.start_pos : r.end_pos] == r.chunk and len(r.chunk) <= 500 for r in rows)
    assert "".join("".join(r.chunk.split()) for r in sorted(rows, key=lambda r: r.chunk_no)) == "".join(text.split())


def test_windows_end_at_the_end(spark):
    df = make(spark, [(1, " ".join(["w"] * 100)), (2, "w")], "k long, text string")
    rows = docs.token_windows(df, "k", "text", 64, 16).orderBy("id", "window_no").collect()
    assert [(r.id, r.first_token, r.last_token) for r in rows] == [(1, 0, 63), (1, 48, 99), (2, 0, 0)]


def test_exact_and_relaxed_matching(spark):
    gold = make(spark, [(1, 0, 5, "A"), (1, 0, 5, "A"), (1, 10, 20, "B"), (2, 0, 3, "A")])
    pred = make(spark, [(1, 0, 5, "A"), (1, 11, 20, "B"), (3, 0, 1, "A")])
    s = spans.prf(spans.exact_matches(pred, gold).withColumn("s", F.lit(1)), ["s"]).first()
    assert (s.tp, s.fp, s.fn) == (1, 2, 3)
    p, g = (greedy.numbered(d, ["start_pos", "end_pos"], "no") for d in (pred, gold))
    assert {(r.id, r.pred_no, r.gold_no) for r in scoring.relaxed_pairs(p, g).collect()} == {(1, 0, 0), (1, 1, 2)}
    same = spans.prf(spans.exact_matches(gold, gold).withColumn("s", F.lit(1)), ["s"]).first()
    assert same.f1 == 1.0
    assert scoring.relaxed_pairs(p.filter("id > 9"), g).count() == 0


def test_greedy_and_clusters(spark):
    rows = [(1, 0, 5, "A", 0.5, "x"), (1, 0, 9, "A", 0.5, "x"), (1, 4, 12, "A", 0.9, "x"), (1, 9, 12, "A", 0.1, "x")]
    kept = fusion.non_overlapping(make(spark, rows, SPAN + ", score double, source string")).collect()
    assert {(r.start_pos, r.end_pos) for r in kept} == {(0, 9), (9, 12)}
    c = {(r.start_pos, r.end_pos): r.cluster_no for r in spans.complete_link_clusters(make(spark, [(1, 0, 10, "A"), (1, 2, 12, "A"), (1, 6, 16, "A")])).collect()}
    assert c[(0, 10)] == c[(2, 12)] != c[(6, 16)]


def test_clusters_of_a_long_text(spark):
    """Many spans of one id, in which only near ones can share a cluster."""
    rows = [(1, 3 * i, 3 * i + 10 + i % 7, "A") for i in range(4000)]
    began, got = time.time(), {(r.start_pos, r.end_pos): r.cluster_no for r in spans.complete_link_clusters(make(spark, rows)).collect()}
    assert time.time() - began < 30
    groups = []
    for _, s, e, _ in sorted(rows):
        near = [(n, g) for n, g in enumerate(groups[-40:], max(0, len(groups) - 40)) if all(2 * (min(e, y) - s) >= (max(e, y) - x) for x, y in g)]
        n = near[0][0] if near else len(groups)
        groups = groups if near else [*groups, []]
        groups[n].append((s, e))
        assert got[(s, e)] == n


def test_similarity_edges(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], []), (None, ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(tx.jaccard(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0, 0.0]
