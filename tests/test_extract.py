from noteweave.operators import extract


def test_dictionary_phrases_of_any_length(spark):
    long = [" ".join("abcdefghijkl"[:n]) for n in (3, 7, 8, 10, 12)]
    table = extract.phrase_table(spark.createDataFrame([(x,) for x in [*long, "x" * 81, "ab"]], "p string"), "p", "T")
    df = spark.createDataFrame([(1, "z " + long[-1] + " z " + "x" * 81), (2, None), (3, "")], "id long, text string")
    assert sorted((r.start_pos, r.n) for r in extract.dictionary_spans(df, "id", "text", table).collect()) == [(2, 3), (2, 7), (2, 8), (2, 10), (2, 12)]


def test_aliases_are_looked_up(spark):
    rows = [("Mệt lả người", "mệt mỏi"), ("mệt mỏi", "mệt mỏi"), ("đau bụng", "đau dạ dày"), ("Đau bụng", "đau bụng"), (None, "sốt"), ("nóng sốt", None)]
    table = extract.phrase_table(spark.createDataFrame(rows, "alias string, canonical string"), "canonical", "T", alias="alias")
    df = spark.createDataFrame([(1, "met la nguoi, đau bụng, sốt")], "id long, text string")
    assert sorted((r.start_pos, r.canonical) for r in extract.dictionary_spans(df, "id", "text", table).collect()) == [(0, "mệt mỏi"), (14, "đau bụng"), (24, "sốt")]


def test_a_large_dictionary_is_joined_without_its_first_words(spark, monkeypatch):
    table = extract.phrase_table(spark.createDataFrame([("đau bụng",), ("sốt",), ("đau",)], "p string"), "p", "T")
    df = spark.createDataFrame([(1, "đau bụng và sốt")], "id long, text string")
    want = sorted(r[:] for r in extract.dictionary_spans(df, "id", "text", table).collect())
    monkeypatch.setattr(extract, "BROADCAST_ROWS", 1)
    assert len(want) == 3 and sorted(r[:] for r in extract.dictionary_spans(df, "id", "text", table).collect()) == want
