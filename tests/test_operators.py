"""Small cases of the operators: nulls, empty texts, ties, repeated rows, empty tables, clashing names."""

import random

import pytest
from noteweave.functions import drugs
from noteweave.functions import text as tx
from noteweave.operators import assertions, cleanup, construction, docs, fusion, greedy, linkers, runs, scoring, terminology, validation, views
from noteweave.sources import files
from pyspark.sql import functions as F


def column(spark, values, f):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "n int, v string, key string")
    return [r.o for r in df.select("n", f(F.col("v")).alias("o")).orderBy("n").collect()]


def test_text_forms(spark):
    assert column(spark, ["Đau  ĐẦU ", None, "", "viêm"], tx.squeeze) == ["Đau ĐẦU", None, "", "viêm"]
    assert column(spark, ["viêm gan", None, ""], tx.nfc) == ["viêm gan", None, ""]
    assert column(spark, ["Viêm Gan – \"B\"", None, ""], tx.bare_key) == ["viem gan-b", None, ""]
    assert column(spark, ["Ảo giác!", None], tx.slug) == ["ao_giac", None]
    assert column(spark, ["a/b 5% c.d", ""], lambda c: F.array_join(tx.key_tokens(c), "|")) == ["a/b|5%|c.d", ""]


def test_drug_mentions(spark):
    got = column(spark, ["Aspirin 81mg PO daily", "5 gram x", "Brandolol", None, "a + b 2,5 mg/ml IV"], drugs.parse)
    assert [(r.name, r.strength_value, r.strength_unit, r.route, r.frequency, r.is_combination) for r in got] == [
        ("aspirin", 81.0, "MG", "po", "daily", False), ("x", 5.0, "G", None, None, False), ("brandolol", None, None, None, None, False), (None, None, None, None, None, False), ("a b ml", 2.5, "MG/ML", "iv", None, True),
    ]


def test_views_and_spans(spark):
    df = spark.createDataFrame([(1, "Á \n b", 0), (2, "", 0), (3, None, 0)], "k int, t string, view int").drop("view")
    rows = {r.k: (r.view, r.raw_at) for r in views.folded_view(df, "t").collect()}
    assert rows[1] == ("a b", [0, 2, 5]) and rows[2] == ("", []) and rows[3][0] is None
    d = spark.createDataFrame([("xx abc abc", 4, 7, "abc"), ("xx abc yy", 1, 4, "abc"), ("x", 0, 1, "")], "t string, a int, b int, s string")
    assert [r.r and (r.r.start_pos, r.r.end_pos) for r in d.select(views.repair_span(F.col("t"), F.col("a"), F.col("b"), F.col("s")).alias("r")).collect()] == [None, (3, 6), None]


def test_chunks_of_long_lines(spark):
    text = "a" * 150 + ". " + "b" * 400 + " " + "c" * 700 + "\r\n\r- x\r\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "  ")], "k int, t string")
    got = docs.chunks(df, "k", "t", 500).orderBy("chunk_no").collect()
    assert all(text[r.start_pos : r.end_pos] == r.chunk and len(r.chunk) <= 500 for r in got) and {r.id for r in got} == {1}
    assert "".join(r.chunk for r in got).replace(" ", "") == "".join(text.split())
    assert [r.line_no for r in got][-1] == 2
    assert [r.start_pos for r in docs.lines(df.filter("k = 1"), "k", "t").orderBy("line_no").collect()] == [0, len(text) - 6, len(text) - 5, len(text)]


def test_long_texts_have_all_their_tokens(spark):
    df = spark.createDataFrame([(1, "từ " * 100_000)], "k int, t string")
    assert docs.tokens(df, "k", "t").agg(F.count("*"), F.max("end_pos")).first()[:] == (100_000, 299_999)


def test_greedy_equals_plain_loop(spark):
    rng = random.Random(1)
    rows = [(t, rng.randrange(6), rng.randrange(6), rng.randrange(4)) for t in range(5) for _ in range(15)]
    rows = list(dict(((r[:3]), r) for r in rows).values())
    df = spark.createDataFrame(rows, "id int, l int, r int, score int")
    got = {(x.id, x.l, x.r) for x in greedy.one_to_one(df, [-F.col("score")], "l", "r").collect()}
    want, used = set(), set()
    for t, a, b, _ in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if ("l", t, a) not in used and ("r", t, b) not in used:
            used |= {("l", t, a), ("r", t, b)}
            want.add((t, a, b))
    assert got == want
    assert greedy.one_to_one(df.filter("id > 99"), [-F.col("score")], "l", "r").count() == 0


def entity(n, a, b, kind, **more):
    base = {"confidence": 0.7, "by_rule": False, "n_codes": 0, "n_slots": 0, "plain": True, "disease_head": False, "symptom_head": False} | more
    return (1, n, a, b, kind, *base.values())


SHAPE = "id int, row int, start_pos int, end_pos int, entity_type string, confidence double, by_rule boolean, n_codes int, n_slots int, plain boolean, disease_head boolean, symptom_head boolean"


def test_overlaps_are_resolved(spark):
    cases = [
        ([entity(1, 0, 10, "CHẨN_ĐOÁN"), entity(2, 0, 4, "CHẨN_ĐOÁN")], {2: "same_type_overlap"}),
        ([entity(1, 0, 10, "TÊN_XÉT_NGHIỆM"), entity(2, 0, 4, "TÊN_XÉT_NGHIỆM")], {}),
        ([entity(1, 0, 10, "THUỐC"), entity(2, 2, 5, "KẾT_QUẢ_XÉT_NGHIỆM")], {1: "lab_result_priority"}),
        ([entity(1, 0, 10, "THUỐC", n_codes=1), entity(2, 2, 5, "TRIỆU_CHỨNG")], {2: "linked_drug_priority"}),
        ([entity(1, 0, 10, "CHẨN_ĐOÁN"), entity(2, 2, 5, "TRIỆU_CHỨNG", symptom_head=True)], {1: "symptom_head_priority"}),
        ([entity(1, 0, 10, "CHẨN_ĐOÁN"), entity(2, 8, 15, "CHẨN_ĐOÁN")], {}),
        ([entity(1, 0, 10, "CHẨN_ĐOÁN"), entity(2, 0, 10, "CHẨN_ĐOÁN"), entity(3, 1, 9, "TRIỆU_CHỨNG")], {2: "same_type_overlap", 3: "higher_confidence"}),
    ]
    for rows, want in cases:
        got = {r.row: r.lost_by for r in cleanup.resolve_overlaps(spark.createDataFrame(rows, SHAPE)).collect()}
        assert {k: v for k, v in got.items() if v} == want and len(got) == len(rows)
    assert cleanup.resolve_overlaps(spark.createDataFrame([], SHAPE)).count() == 0


def test_trimming(spark):
    doc = "- không có đau đầu. nghi ngờ viêm phổi; nghi ngờ"
    rows = [(1, 0, 19, "TRIỆU_CHỨNG"), (2, 20, 38, "CHẨN_ĐOÁN"), (3, 40, 48, "CHẨN_ĐOÁN")]
    df = spark.createDataFrame([(*r, doc, None) for r in rows], "id int, start_pos int, end_pos int, entity_type string, doc string, assertions array<string>")
    got = {r.id: (r.text, r.assertions) for r in cleanup.trim_spans(df).collect()}
    assert got == {1: ("đau đầu", ["isNegated"]), 2: ("viêm phổi", []), 3: ("nghi ngờ", [])}


SAID = [
    ("bệnh nhân không có sốt", "sốt", ["isNegated"]), ("không loại trừ viêm phổi", "viêm phổi", []), ("không ho nhưng sốt", "sốt", []), ("sốt: không ghi nhận bất thường", "sốt", ["isNegated"]), ("không đau, bệnh nhân sốt", "sốt", []),
    ("tiền sử viêm gan", "viêm gan", ["isHistorical"]), ("hiện tại, tiền sử viêm gan", "viêm gan", []), ("mẹ bị viêm gan", "viêm gan", ["isFamily"]), ("mẹ kể bệnh nhân bị sốt", "sốt", []), ("Tiền sử: mẹ mắc viêm gan", "viêm gan", ["isHistorical", "isFamily"]),
]


def test_assertions(spark):
    docs_ = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SAID)] + [(98, None), (99, "")], "id int, doc string")
    ents = spark.createDataFrame([(i, t.index(e), t.index(e) + len(e), "CHẨN_ĐOÁN") for i, (t, e, _) in enumerate(SAID)], "id int, start_pos int, end_pos int, entity_type string")
    got = {r.id: r.assertions for r in assertions.assert_entities(ents, docs_, assertions.cue_hits(docs_, "id", "doc")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(SAID)}


def test_record_issues(spark):
    cases = {
        '[{"text":"ab","position":[0,2],"type":"THUỐC","assertions":[],"candidates":[]}]': [], "{}": ["top_level_not_list"], "[1]": ["record_not_object"],
        '[{"text":"ab","position":[0,2],"type":"THUỐC","assertions":[],"candidates":null}]': ["candidates_not_list", "none_value"],
        '[{"text":"b","position":[0,1],"type":"TRIỆU_CHỨNG","assertions":["isNegated","isNegated"]}]': ["duplicate_assertion", "offset_mismatch"],
        '[{"text":"a","position":[true,1],"type":"TRIỆU_CHỨNG","assertions":[]}]': ["position_not_int"], "[]": [],
        '[{"text":"a","position":[0,1],"type":"TRIỆU_CHỨNG","assertions":[]},{"text":"a","position":[0,1],"type":"TRIỆU_CHỨNG","assertions":[]}]': ["duplicate_exact_span_type", "overlapping_entities"],
    }
    pred = spark.createDataFrame(list(enumerate(cases)), "id int, json string")
    inputs = spark.createDataFrame([(i, "abc") for i in range(len(cases))], "id int, doc string")
    got = {i: [] for i in range(len(cases))}
    for r in validation.record_issues(inputs, pred).collect():
        got[r.id].append(r.code)
    assert {k: sorted(v) for k, v in got.items()} == dict(enumerate(cases.values()))
    bad = spark.createDataFrame([(1, "x")], "id int, json string")
    assert [r.code for r in validation.file_issues(inputs.filter("id < 2"), bad).orderBy("id").collect()] == ["prediction_file_missing", "json_parse_error"]


def test_terminology_ties_and_empty_tables(spark):
    df = spark.createDataFrame([("a1.0", "B", "x"), ("A1.0", "A", None), ("", "C", "z"), (None, "D", "")], "code string, vi string, en string")
    index = terminology.diagnosis_index(df, "code", "vi", "en")
    assert [(r.code, r.canonical_name_vi) for r in index.collect()] == [("A1.0", "A")]
    manual = spark.createDataFrame([("alias", "A1.0"), ("alias", "Z9"), (None, "A1.0")], "alias string, code string")
    assert sorted(r.alias for r in terminology.diagnosis_aliases(index, manual).collect()) == ["A", "alias"]
    assert terminology.diagnosis_index(df.filter("code = 'none'"), "code", "vi", "en").count() == 0
    words = spark.createDataFrame([(f"tên {i:03d}", str(i)) for i in range(100)] + [("TÊN 001", "x"), ("a", "y"), (None, "z")], "surface string, concept_id string")
    got = [r.surface for r in terminology.evenly_spaced(words, 4).orderBy("place").collect()]
    assert [g.lower() for g in got] == ["tên 000", "tên 033", "tên 066", "tên 099"]


def test_selection(spark):
    rows = [("m", "A", 0.9, 1), ("m", "B", 0.89, 2), ("m", "C", 0.5, 3), ("n", "A", 0.4, 1)]
    df = spark.createDataFrame(rows, "mention string, code string, final double, rank int")
    assert sorted((r.mention, r.code) for r in linkers.select(df, 0.65, 0.02, 0.70, 3).collect()) == [("m", "A"), ("m", "B")]


def test_decoding(spark):
    doc = "abc def  ghi"
    rows = [(0, 3, "B-X", 0.9), (4, 7, "I-X", 0.7), (9, 12, "I-X", 0.9)]
    df = spark.createDataFrame([(1, a, b, y, s, doc) for a, b, y, s in rows], "id int, start_pos int, end_pos int, label string, score double, doc string")
    assert [(r.start_pos, r.end_pos) for r in fusion.decode_tokens(df, 0.8).orderBy("start_pos").collect()] == [(0, 7), (9, 12)]
    assert fusion.decode_tokens(df, 0.85).count() == 1


def test_noise_keeps_spans(spark):
    texts = ["Bệnh nhân đau đầu nhiều", "sốt cao", "ho khan kéo dài", "viêm phổi nặng"]
    rows = [(i, i, t, [(0, len(t.split()[0]))]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, number int, text string, entities array<struct<start_pos:int,end_pos:int>>")
    got = {r.id: (r.noise, r.text, r.text[r.spans[0].start_pos : r.spans[0].end_pos]) for r in construction.add_noise(df, "number").collect()}
    assert got[0] == ("no_diacritics", "Benh nhan dau dau nhieu", "Benh") and got[1] == ("missing_space", "sốtcao", "sốt")
    assert got[2][2] == "hoho" and got[3][0] == "dropped_vowel" and got[3][2] == "vêm"


def test_dataset_hash_ignores_order(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", None) for i in range(200)], "id int, t string, n string")
    a, b = (construction.dataset_hash(d, ["id", "t", "n"]).first() for d in (df, df.repartition(17)))
    assert a == b and construction.dataset_hash(df.filter("id > 0"), ["id", "t", "n"]).first() != a
    assert construction.dataset_hash(df.filter("id < 0"), ["id", "t", "n"]).first().rows == 0


def test_registry(spark):
    df = spark.createDataFrame([("a", "f", None), ("b", "f", "a"), ("c", "f", "d"), ("d", "f", "c"), ("e", "f", "c"), ("g", "h", "a"), ("i", "f", "zz"), ("b", "f", "a")], "run_id string, family string, parent_id string")
    got = {(r.run_id, r.code) for r in runs.registry_issues(df).collect()}
    assert got == {("b", "duplicate_run_id"), ("c", "parent_cycle"), ("d", "parent_cycle"), ("e", "parent_cycle"), ("g", "parent_of_other_family"), ("i", "unknown_parent")}


def test_scores_of_equal_sides_are_one(spark):
    rows = [(t, n, n * 5, n * 5 + 4, k, f"w{n}", ["isNegated"], ["c"]) for t in (1, 2) for n, k in enumerate(("THUỐC", "CHẨN_ĐOÁN", "TRIỆU_CHỨNG"))]
    g = spark.createDataFrame(rows, "id int, no int, start_pos int, end_pos int, entity_type string, text string, assertions array<string>, candidates array<string>")
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    assert scoring.corpus_score(scoring.text_scores(g, g, ids)).first()[:] == (1.0, 1.0, 1.0, 1.0)
    none = scoring.text_scores(g.filter("id < 0"), g, ids).collect()
    assert [(r.text, r.n_pred) for r in none] == [(0.0, 0), (0.0, 0)]


def test_files(spark, tmp_path):
    t = str(tmp_path)
    df = spark.createDataFrame([("10",), ("b",), ("9",), ("a",), (None,)], "name string")
    assert [r.name for r in files.in_natural_order(df, "name").collect()][:2] == ["9", "10"]
    samples = spark.createDataFrame([("f", "đau", "s", None, None, 1, None)], files.SAMPLE)
    files.write_samples(samples, t + "/s")
    files.write_samples(samples, t + "/s", "append")
    assert files.read_samples(spark, t + "/s").count() == 2 and files.read_samples(spark, t + "/s").first().text == "đau"
    files.write_tables({"a": df}, t + "/tables")
    assert files.read_tables(spark, t + "/tables", {"a": ["name"]})["a"].count() == 5
    for i in (1, 2):
        files.write_json(f"{t}/out/{i}.json", [{"text": "đ"}])
    assert files.zip_records(t + "/out", t + "/z.zip", 2) == ["1.json", "2.json"]
    with pytest.raises(FileExistsError):
        files.zip_records(t + "/out", t + "/z.zip", 2)
    with pytest.raises(FileNotFoundError):
        files.zip_records(t + "/out", t + "/y.zip", 3)
    files.write_text(t + "/c/a.yaml", "x: {p: 1, q: 2}\ny: 1\n")
    files.write_text(t + "/c/b.yaml", "extends: a.yaml\nx: {q: 3}\n")
    assert files.load_config(t + "/c/b.yaml") == {"x": {"p": 1, "q": 3}, "y": 1}
    files.write_text(t + "/c/a.yaml", "extends: b.yaml\n")
    with pytest.raises(ValueError):
        files.load_config(t + "/c/b.yaml")
    store = spark.createDataFrame([("k", 1, 5), ("k", 2, 6)], "key string, value int, stored_at int")
    found, missing = files.split_by_store(spark.createDataFrame([("k",), ("m",)], "key string"), store)
    assert [r.value for r in found.collect()] == [2] and [r.key for r in missing.collect()] == ["m"]


def test_match_ratio_is_symmetric_in_length(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, ""), ("x", None)], "a string, b string")
    assert [round(r.r, 6) for r in df.select(construction.match_ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [0.75, 1.0, 0.0]
