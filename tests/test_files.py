import json

from noteweave.functions.wer import error_rate, word_distance
from noteweave.operators import retrieval
from noteweave.sources import files
from pyspark.sql import functions as F


def test_notes_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("10.txt", "đau\nđầu"), ("2.txt", ""), ("x.txt", "y")):
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    rows = {r.file_id: r for r in files.read_notes(spark, str(tmp_path / "in")).collect()}
    assert rows["10"].text == "đau\nđầu" and rows["10"].ord == 10 and rows["x"].ord is None
    spans = spark.createDataFrame([(1, "b", 5, 6, "THUỐC", ["isNegated"], None), (1, "a", 0, 1, "TRIỆU_CHỨNG", None, None)], "id long, text string, start_pos int, end_pos int, entity_type string, assertions array<string>, candidates array<string>")
    made = json.loads(files.format_records(spans).first().json)
    assert made == [{"text": "a", "position": [0, 1], "type": "TRIỆU_CHỨNG", "assertions": []}, {"text": "b", "position": [5, 6], "type": "THUỐC", "assertions": ["isNegated"], "candidates": []}]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "1.json").write_text(json.dumps(made, ensure_ascii=False), encoding="utf-8")
    assert files.read_records(spark, str(tmp_path / "out")).first().records[1].candidates == []


def test_terminology_files(spark, tmp_path):
    line = "|".join(["1", "ENG", "", "", "", "", "", "", "", "", "", "RXNORM", "IN", "1", "zed", "", "N", ""]) + "|"
    (tmp_path / "a.rrf").write_text(line + "\n" + line.replace("|N|", "|O|") + "\n")
    d = files.read_drug_rrf(spark, str(tmp_path / "a.rrf"))
    assert d.count() == 2 and files.keep_drug_rows(d, ["RXNORM"], ["IN"]).first().STR == "zed"
    (tmp_path / "i.csv").write_text("﻿CODE;NAME\nthe code;the name\nA00.1;x\nB01;\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_diagnosis_csv(spark, str(tmp_path / "i.csv")).orderBy("CODE").collect()] == [("A00.1", "x"), ("B01", "")]


def test_error_rate():
    assert error_rate("a b c", "a x c d") == 2 / 3 and error_rate("", "") == 0 and error_rate(None, "a") == 1 and error_rate("a", None) == 1
    assert word_distance(["a"] * 500, ["a"] * 499) == 1


def test_retrieval_and_audit_edges(spark):
    none = spark.createDataFrame([], "id string, t string")
    docs = retrieval.postings(spark.createDataFrame([("a", "viêm gan"), ("b", "viêm da"), ("c", None)], "id string, t string"), "id", retrieval.word_terms(F.col("t")))
    q = retrieval.postings(spark.createDataFrame([("1", "gan viêm")], "id string, t string"), "id", retrieval.word_terms(F.col("t")))
    assert [r.code for r in retrieval.bm25_top(q, docs, 2).orderBy("rank").collect()] == ["a", "b"]
    assert retrieval.bm25_top(retrieval.postings(none, "id", retrieval.word_terms(F.col("t"))), docs, 2).count() == 0
