import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from noteweave.llm import canon, linking, mixing, neardup, overlap, packing, pii, shingles, tokens, toxicity
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def jaccard(a, b, k=3):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(80)]
        texts.append(base)
        for _ in range(rng.randrange(3)):
            t = list(base)
            for _ in range(rng.randrange(1, 5)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            if rng.random() < 0.4:
                t = t[40:] + t[:40]
            texts.append(t)
    return [" ".join(t) for t in texts]


def test_canonical_forms():
    same = ["đau lan", "ðau lan", "đau lan", "đ​au lan", "đаu lаn", "ｄau lan".replace("ｄ", "đ"), "đau　lan"]
    assert {canon.canonical(x) for x in same} == {"đau lan"}
    assert canon.canonical("vie\u0302m") == "viêm"
    assert canon.canonical("АСНE") == "ACHE"
    for x in ["µg 37 °C 1,73 m² ½ ±", "α-fetoprotein, β2-microglobulin", "", "  "]:
        assert canon.canonical(x) == x
    t, place = canon.canonical_with_offsets("a\u200be\u0301 x")
    assert t == "aé x" and len(place) == 5 and place[-1] == 6


def test_find_variants(spark):
    df = spark.createDataFrame([(1, "sạch", 0), (2, "b​ẩn", 0), (3, None, 0), (4, "", 0)], "k long, t string, row_key int")
    assert [r.row_key for r in canon.find_variants(df, "t", "k").collect()] == [2]
    out = canon.unify_characters(df, "t", "t").orderBy("k").collect()
    assert [r.t for r in out] == ["sạch", "bẩn", None, ""]


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus(1, 60) + ["", None, "a b", "a b"]
    texts += [texts[0]] * 40
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "k long, text string, id int")
    got = {(r.id_a, r.id_b) for r in neardup.similar_records(df, "text", "k", 3, 0.5, 0.99).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] and texts[b] and jaccard(texts[a], texts[b]) >= 0.5}
    assert got <= want and len(got) >= 0.98 * len(want)
    groups = {r.id: r for r in neardup.similar_groups(df, "text", "k", 3, 0.5, 0.99).collect()}
    assert len(groups) == len(texts) and groups[61 if texts[61] else 0] is not None
    assert len({groups[i].class_id for i in range(len(texts) - 40, len(texts))} | {groups[0].class_id}) == 1
    assert groups[texts.index("")].class_id is None
    none = df.filter("k < 0")
    assert neardup.similar_records(none, "text", "k", 3, 0.5).count() == 0


def test_bands_for_a_target_recall():
    for least, recall in ((0.5, 0.9), (0.5, 0.95), (0.8, 0.99)):
        bands, rows = neardup.choose_bands(least, recall)
        reached = lambda b, s: 1 - (1 - s**rows) ** b  # noqa: E731, B023
        assert reached(bands, least) >= recall > reached(bands - 1, least)
    assert neardup.choose_bands(1.0, 0.9)[0] == 1


def test_the_shipped_setting_reaches_its_recall(spark):
    """Pairs of many similarities from 0.45 up, by the setting that p1_found uses."""
    from noteweave.llm import queries

    rng = random.Random(11)
    texts = []
    for i in range(400):
        base = [f"u{i}x{j}" for j in range(90)]
        other = list(base)
        for at in rng.sample(range(90), 4 + i % 8):
            other[at] = f"v{i}"
        texts += [" ".join(base), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {(r.id_a, r.id_b) for r in neardup.similar_records(df, "text", "k", queries.WORDS, queries.LEAST, queries.RECALL).collect()}
    share = {(i, i + 1): jaccard(texts[i], texts[i + 1]) for i in range(0, 800, 2)}
    want = {p for p, s in share.items() if s >= 0.5}
    low = {p for p, s in share.items() if 0.5 <= s < 0.6}
    assert got <= want and len(low) > 50 and len(got & low) >= 0.88 * len(low) and len(got) >= 0.96 * len(want)


def test_signatures_are_made_in_a_small_buffer():
    """The minima of all hashes of a text's runs, without an array of all runs and hashes of a batch."""
    texts = [" ".join(WORDS[(i * j + j) % 400] for j in range(120)) for i in range(300)] + ["a b", "", "a b c", " ".join(WORDS)]
    w = shingles.words(texts)
    tracemalloc.start()
    sig, ids = shingles.minhash(w, 3, 365)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    h, doc = w.windows(3)
    assert ids.tolist() == [*range(300), 302, 303] and len(h) > 1 << 15 and peak < 10 << 20
    for i, row in zip(ids, sig, strict=True):
        v = ((h[doc == i] >> np.uint64(32)).astype(np.uint32)[:, None] ^ shingles._XOR[:365]) * shingles._PERM[:365]
        assert (row == ((v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)).min(axis=0)).all()


def test_hot_copies_and_block_pairs(spark, monkeypatch):
    from noteweave.llm import pairing

    monkeypatch.setattr(pairing, "BLOCK", 7)
    rows = spark.createDataFrame([("x", f"i{i:02d}") for i in range(40)] + [("y", "a"), ("y", "b"), ("z", "a")], "fp string, id string")
    got = sorted((r.a, r.b) for r in pairing.pairs_within(rows, "fp", "id").collect())
    assert got == sorted([*itertools.combinations([f"i{i:02d}" for i in range(40)], 2), ("a", "b")])


def test_big_groups_are_split(spark, monkeypatch):
    from noteweave.llm import pairing

    monkeypatch.setattr(pairing, "BLOCK", 5)
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 1), (2, 2), (3, 7)], "key long, id long")
    assert {(r.a, r.b) for r in pairing.pairs_sharing_key(rows).collect()} == set(itertools.combinations(range(30), 2))


def test_split_overlaps_equal_brute_force(spark):
    texts = corpus(2, 60) + ["", None, "a b"]
    rng = random.Random(5)
    rows = [(i, f"f{i // 2 if i % 9 == 0 else i}", t, rng.choice(["train", "train", "dev", None]), "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n long, f string, t string, split string, source string")
    got = {(r.row_a, r.row_b) for r in overlap.split_overlaps(df, "t", "n", "f", "split", "source", "train", 3, 0.5).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[3] == "train") != (b[3] == "train") and (a[1] == b[1] or a[2] and b[2] and jaccard(a[2], b[2]) >= 0.5)}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_overlaps_need_no_long_common_run(spark):
    """Pairs at the threshold whose common runs all have 6 to 9 words, one text much longer than the other, and one edited every 9 words."""
    rng, rows = random.Random(21), []
    for i in range(30):
        base = [f"b{i}x{j}" for j in range(60 + i)]
        length = 6 + i % 4
        parts = [base[a : a + length] for a in range(0, len(base), length)]
        rng.shuffle(parts)
        edited = [f"e{i}" if j % 9 == 8 else w for j, w in enumerate(base)]
        longer = [*base, *(f"l{i}x{j}" for j in range(len(base) - 6))]
        rows += [(4 * i, base, "train"), (4 * i + 1, [w for p in parts for w in p], "dev"), (4 * i + 2, edited, "dev"), (4 * i + 3, longer, "dev")]
    rows = [(n, " ".join(t), s) for n, t, s in rows]
    df = spark.createDataFrame(rows, "n long, t string, split string").select("n", F.col("n").cast("string").alias("f"), "t", "split", F.lit("s").alias("source"))
    got = {(r.row_a, r.row_b) for r in overlap.split_overlaps(df, "t", "n", "f", "split", "source", "train", 3, 0.5).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[2] == "train") != (b[2] == "train") and jaccard(a[1], b[1]) >= 0.5}
    assert len({b % 4 for _, b in want}) == 3 and got == want


def test_overlaps_of_crowded_segments(spark):
    rng = random.Random(7)
    texts, copies = [], []
    for _ in range(3):  # copied into many tasks; the partner differs in every 16th word
        base = [rng.choice(WORDS) for _ in range(64)]
        copies += [" ".join(base)] * 40
        texts.append(" ".join("edited" if i % 16 == 15 else w for i, w in enumerate(base)))
    stock = [rng.choice(WORDS) for _ in range(15)]  # a stock phrase of many different texts; pairs share little beyond it
    for i in range(30):
        base = [rng.choice(WORDS) for _ in range(17)]
        copies.append(" ".join([*base[:1], *stock, *base[1:4]]))
        texts.append(" ".join([*base[4:5], *stock, *base[5:8]]))
        copies.append(" ".join([*base, *stock, *reversed(base)]))
    rows = [(i, t, "train") for i, t in enumerate(copies)] + [(1000 + i, t, "dev") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n long, t string, split string").repartition(40)
    df = df.select("n", F.col("n").cast("string").alias("f"), "t", "split", F.lit("s").alias("source"))
    got = {(r.row_a, r.row_b) for r in overlap.split_overlaps(df, "t", "n", "f", "split", "source", "train", 3, 0.5).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.product(rows, rows) if a[2] == "train" and b[2] == "dev" and jaccard(a[1], b[1]) >= 0.5}


def test_hot_segments_take_another_way_to_the_same_result(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(60):  # every text holds one of three runs of 16 words
        own = [f"t{i // 2 % 6}q{j}" for j in range(16)]
        stock = [f"s{i // 2 % 3}p{j}" for j in range(16)]
        rows.append((i, " ".join([*own, *stock] if rng.random() < 0.5 else [*stock, *own]), "train" if i % 2 else "dev"))
    df = spark.createDataFrame(rows, "n long, t string, split string").select("n", F.col("n").cast("string").alias("f"), "t", "split", F.lit("s").alias("source"))

    def found():
        return {(r.row_a, r.row_b) for r in overlap.split_overlaps(df, "t", "n", "f", "split", "source", "train", 3, 0.5).collect()}

    want = found()
    monkeypatch.setattr(overlap, "HOT", 2)
    assert want and found() == want


def test_rounds_give_the_same_pairs(spark, monkeypatch):
    """Parts matched in rounds, whose shuffle files are freed one after the other, find what all at once find."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([12, 40, 200]))) for _ in range(40)]
    rows = [(i, t if i % 3 else t + " " + WORDS[i % 7], "train" if i < 40 else "dev") for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "n long, t string, split string").select("n", F.col("n").cast("string").alias("f"), "t", "split", F.lit("s").alias("source"))
    freed = []
    monkeypatch.setattr(overlap, "free_shuffles", freed.append)

    def found():
        return {(r.row_a, r.row_b) for r in overlap.split_overlaps(df, "t", "n", "f", "split", "source", "train", 3, 0.5).collect()}

    want = found()
    assert want and not freed
    for together, direct, rounds in ((1, 1 << 11, 4), (2, 0, 2)):
        monkeypatch.setattr(overlap, "TOGETHER", together)
        monkeypatch.setattr(overlap, "DIRECT", direct)
        freed.clear()
        assert found() == want and len(freed) == rounds


def test_seeds_do_not_depend_on_the_way(monkeypatch):
    rng = np.random.default_rng(1)
    n = 400
    keys, ids = np.sort(rng.integers(0, 3, n)), rng.integers(0, 60, n)
    tags = ((rng.integers(0, 2, n).astype(np.uint64) << np.uint64(overlap.AFTER)) | (ids.astype(np.uint64) << np.uint64(1)) | (ids % 3 > 0)).view(np.int64)

    def seeds(direct, block):
        monkeypatch.setattr(overlap, "DIRECT", direct)
        monkeypatch.setattr(overlap, "BLOCK", block)
        rows = [r for b in overlap._match(keys, ids, tags, False, 9) for r in b.to_pylist()]
        cells = {}
        for r in (r for b in overlap._match(keys, ids, tags, True, 9) for r in b.to_pylist()):
            cells.setdefault(r["cell"], []).append(r)
        assert all(sum(r["tag"] % 2 == s for r in c) <= block for c in cells.values() for s in (0, 1))
        far = [(a["id"], b["id"]) for c in cells.values() for a in c for b in c if a["tag"] % 2 == 0 and b["tag"] % 2 == 1]
        return sorted([(r["a"], r["b"]) for r in rows] + far)

    want = seeds(10**9, 1 << 10)
    assert want and seeds(0, 7) == want and seeds(3, 16) == want


def test_overlaps_verify_few_long_texts_that_share_a_phrase(spark, monkeypatch):
    """Long texts of the two sides share five words and no more: their bitmaps tell before any word list is sent."""
    phrase = lambda i, c: [f"p{i}x{c}x{j}" for j in range(5)]
    rows = []
    for i in range(120):
        base = [f"b{i}x{j}" for j in range(300)]
        rows += [(4 * i, [*base, *phrase(i, 0)], "train"), (4 * i + 1, [*phrase(i, 0), *(f"o{i}x{j}" for j in range(300))], "dev")]
        if i < 5:
            rows.append((4 * i + 2, ["other" if j % 40 == 20 else w for j, w in enumerate(base)], "dev"))
    df = spark.createDataFrame([(n, " ".join(t), s) for n, t, s in rows], "n long, t string, split string")
    df = df.select("n", F.col("n").cast("string").alias("f"), "t", "split", F.lit("s").alias("source"))
    sent, lists = [], overlap.with_word_lists
    monkeypatch.setattr(overlap, "with_word_lists", lambda candidates, *rest: (sent.append(candidates.count()), lists(candidates, *rest))[1])
    got = {(r.row_a, r.row_b) for r in overlap.split_overlaps(df, "t", "n", "f", "split", "source", "train", 3, 0.5).collect()}
    assert got == {(4 * i, 4 * i + 2) for i in range(5)} and sent == [5]


def test_banded_alignment():
    x = np.array([1, 2, 3, 4, 9, 1, 2], np.uint32)
    y = np.array([7, 1, 2, 3, 4, 1, 2], np.uint32)
    got = overlap.banded_alignment(x, np.array([0, 5, 7]), y, np.array([0, 5, 7]), np.array([1, 0]), 2)
    assert got.tolist() == [4, 2]


def test_packed_segments_are_all_there_and_bitmaps_never_differ_in_more_than_the_runs():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(3000)]
    texts = [" ".join(base[a : a + n]) for a, n in [(rng.randrange(300), rng.choice([3, 40, 143, 200, 500, 2400])) for _ in range(60)]] + ["", "a b"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    levels, none = np.zeros(overlap.SLOTS, np.uint8), np.zeros(overlap.SLOTS, bool)
    (f,) = overlap._firsts(iter([batch]), 3, 0.5, True, levels)
    rows = [r for b in overlap._pack(3, 0.5, True, levels, none, 7)(iter([batch])) for r in b.to_pylist()]
    got = []
    for r in rows:
        keys, doc, place, ids, tags, of, tables = overlap._unpack([r["packed"], r["packed"]])
        assert len(of) == len(tables) and sorted(np.concatenate(of).tolist()) == list(range(len(ids)))
        got += list(zip(keys.tolist(), ids[doc].tolist(), place.tolist(), tags[doc].tolist(), strict=True))[: len(keys) // 2]
    assert sorted(got) == sorted(zip((f.values >> np.uint64(32)).tolist(), f.ids[f.doc].tolist(), f.place.tolist(), f.tags[f.doc].tolist(), strict=True))
    marks = overlap._Bitmaps.of(np.split(np.arange(len(f.ids)), np.cumsum(f.texts)[:-1]), f.tables, np.arange(len(f.ids)))
    again = overlap._Bitmaps.read(np.array(marks.written(), object))
    sets = {int(shingles.words([t]).fingerprints()[0]): {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts}
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(f.ids)), np.arange(len(f.ids))))
    apart = np.array([len(sets[f.ids[a]] ^ sets[f.ids[b]]) for a, b in zip(i, j, strict=True)])
    assert (marks.differ(i, j) <= apart).all() and (marks.differ(i, j) == again.differ(i, j)).all() and (marks.differ(i, j) > 0).sum() > len(i) / 2


PII = [
    ("Họ tên: Ninh Lạc Thư Vy", [("NAME", "Ninh Lạc Thư Vy")]),
    ("gọi (+84) 686 527 158 nhé", [("PHONE", "(+84) 686 527 158")]),
    ("mail pham-nhien+kham(at)benhvien.example.", [("EMAIL", "pham-nhien+kham(at)benhvien.example")]),
    ("số định danh HT 1 99 742 2843253.", [("ID", "HT 1 99 742 2843253")]),
    ("Thường trú tại số 112/43 đường Hoa Gạo, phường Vĩnh Trầm, quận Lâm Hải vì", [("ADDRESS", "số 112/43 đường Hoa Gạo, phường Vĩnh Trầm, quận Lâm Hải")]),
    ("Máy thở mã 10544529, mẫu bệnh phẩm 2025067791, phiếu chỉ định số 250452-15", []),
    ("Nghiệm pháp Trầm Ngư dương tính, thang điểm Lạc Hồ 8, độ lọc cầu thận 98", []),
    ("gọi ０６６​0 483 921", [("PHONE", "０６６​0 483 921")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), PII)
def test_personal_data(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.find(text)] == want


def test_redaction_and_validators(spark):
    assert pii.redact("Email a.b@c.example gọi 0660483921.") == "Email [EMAIL] gọi [PHONE]."
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432")
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a.b@c.example " + "x " * 20000, 0)], "k long, text string, key int")
    assert [(r.key, r.pii_kind) for r in pii.find_personal_data(df, "text", "k").collect()] == [(3, "EMAIL")]


def test_linking(spark):
    rx = spark.createDataFrame([("1", "IN", "umbendabavastel"), ("2", "BN", "Tiliaplus"), ("3", "MIN", "thoxomycor / dorfaoxetil")], "rxcui string, tty string, name string")
    cases = {"UMBENDABAVASTEL 50 mg iv bid": "1", "umbendabvastel": "1", "dùng tilia-plus (mua ngoài)": "2", "Dorfaoxetil + thoxomycor 5MG": "3", "umbendaba.": "1", "cao xoa bóp": None, "": None, None: None}
    df = spark.createDataFrame([(i, k, "clash") for i, k in enumerate([*cases, "umbendabvastel"])], "n long, t string, value string")
    got = {r.t: r.code for r in linking.link(df, "t", "drug", rx).collect()}
    assert got == cases
    icd = spark.createDataFrame([("A1", "viêm tá tràng bên trái", "left inflammation of the duodenum"), ("A2", "viêm tá tràng bên phải", "right inflammation of the duodenum"), ("A3", "viêm bể thận típ 1", "type 1 inflammation of the renal pelvis")], "code string, name_vi string, name_en string")
    cases = {"vieem tas trangf been trais": "A1", "VIEM TA TRANG ben phai": "A2", "tá tràng viêm trái": "A1", "VTT bên phải": "A2", "viêm bể thận típ 2": None, "viêm bể thân tuýp I": "A3", "Right inflammation of the duodenum?": "A2"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "n long, t string")
    linked = linking.link(df, "t", "diagnosis", icd)
    assert {r.t: r.code for r in linked.collect()} == cases
    assert [r.t for r in linking.unmatched(df, linked, "n").collect()] == ["viêm bể thận típ 2"]
    assert linking.link(df.filter("n < 0"), "t", "diagnosis", icd).count() == 0


def test_packing_plan_and_documents(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 40, 63, 99, 100, 101, 250, 250])) for i in range(3000)]
    df = spark.createDataFrame([*sizes, (5000, None)], "doc long, n_tokens long")
    rows = packing.pack(df, "doc", 100).collect()
    total, places = {}, {}
    for r in rows:
        total[r.container] = total.get(r.container, 0) + r.n_tokens
        places.setdefault(r.container, []).append(r.place)
    assert max(total.values()) <= 100
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by = {}
    for r in rows:
        by.setdefault(r.doc, []).append(r.n_tokens)
    assert {d: sum(v) for d, v in by.items()} == {d: n for d, n in sizes if n}
    assert all(len(by[d]) == 1 for d, n in sizes if 0 < n <= 100)
    best = -(-sum(n for _, n in sizes) // 100)
    assert len(total) <= 1.1 * best + 1
    assert packing.pack(df.filter("doc < 0"), "doc", 100).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(1, 50), 0.1 + rng.random() * 0.9) for i in range(3000)] + [(9000, None, 5, 1.0), (9001, "big", 0, 1.0), (9002, "other", 5, 1.0)]
    df = spark.createDataFrame(rows, "doc long, source string, n_tokens long, weight double")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, "doc")
    uses = {r.doc: r for r in mixed.collect()}
    assert len(uses) == len(rows) and max(r.uses for r in uses.values() if r.source == "small") <= 3
    assert uses[9000].uses == uses[9001].uses == uses[9002].uses == 0
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert abs(report["big"].actual_share - 4 / 9) < 0.01 and report["absent"].actual_share == 0
    drawn = [r.weight for r in uses.values() if r.source == "big" and r.uses] if report["big"].docs_used < 1999 else [1]
    assert drawn


def test_mixing_passes_over_long_documents(spark):
    rows = [(i, "a", 20, 0.5) for i in range(500)] + [(600, "b", 3000, 1.0)] + [(601 + i, "b", 30, 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc long, source string, n_tokens long, weight double")
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, "doc")
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert abs(report["b"].actual_share - 0.2) < 0.002 and report["b"].most_uses <= 2 and report["b"].shortfall == ""
    targets = spark.createDataFrame([("a", 0.99, 1), ("b", 0.01, 1)], "source string, target_share double, max_repeats int")
    only = df.filter("source = 'a' or doc = 600")
    report = {r.source: r for r in mixing.mix_report(mixing.mix(only, targets, "doc"), targets).collect()}
    assert report["b"].tokens_used == 0 and report["b"].shortfall != "" and report["a"].shortfall == ""
    assert mixing.mix(df.filter("doc < 0"), targets, "doc").count() == 0


def test_mixing_prefers_heavy_weights(spark):
    df = spark.createDataFrame([(i, "a", 10, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(9000 + i, "b", 10, 1.0) for i in range(200)], "doc long, source string, n_tokens long, weight double")
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    used = mixing.mix(df, targets, "doc").filter("source = 'a' and uses > 0").groupBy("weight").count().collect()
    n = {r["weight"]: r["count"] for r in used}
    # 800 draws without replacement among 2,000 of weight 1 and 2,000 of weight 0.1: the first lose mass as they go
    assert sum(n.values()) == 800 and n[1.0] > 6 * n[0.1]


def test_token_counts(spark):
    pytest.importorskip("tokenizers")
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (4, "<|endoftext|>", 9)], "k long, text string, n int")
    got = {r.k: r.n_tokens for r in tokens.count_tokens(df, "text", ["k"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_abuse_is_found(spark):
    good = ["Khám thấy gáy hơi đỏ, ấn đau nhẹ.", "Breast exam normal, no nipple discharge.", "Xét nghiệm kali máu 4.1 mmol/L.", "Kể rằng bị chồng chửi mắng nhiều lần.", "Người nhà bực vì chờ lâu."]
    bad = ["Tụi bay khốn nạn, tao mà gặp ngoài đường là tao chém.", "Shut your mouth, dumb bastard, or I will break your teeth.", "Send me a picture of your naked ass, you stupid cow!"]
    rng = random.Random(3)
    rows = [(i, " ".join([*(rng.choice(good) for _ in range(4)), *([rng.choice(bad)] if i % 7 == 0 else [])])) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(150)] + [(3, 0)], "doc long, toxic int")
    found = toxicity.fit(df, "text", "doc", labels)
    s = {r.doc: r.score for r in toxicity.score(df, "text", ["doc"], found.weights).collect()}
    flagged = {d for d, x in s.items() if x >= found.threshold}
    assert flagged == {i for i in range(300) if i % 7 == 0} and s[900] == s[901] == 0
    assert toxicity.votes(toxicity.sentences("đ.ồ k h ố n n ạ n")[0]) >= 0


def test_shingles_of_long_text():
    t = " ".join(WORDS[i % 400] for i in range(200_000))
    w = shingles.words([t, "", "a"])
    assert w.counts().tolist() == [200_000, 0, 1]
    sig, ids = shingles.minhash(w, 3, 8)
    again, _ = shingles.minhash(shingles.words([t]), 3, 8, step=1000)
    assert ids.tolist() == [0] and (sig == again).all()
    assert F is not None
