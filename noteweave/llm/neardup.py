"""Groups of nearly equal texts, by MinHash banding with exact verification.

Texts are compared as sets of word runs (see ``shingles``). A signature of
``bands * rows`` minima is cut into bands; texts with an equal band are a
candidate pair; each pair is verified on the whole sets. ``choose_bands`` gives
the number of bands that reaches a wanted recall at the threshold itself: 73
bands of 5 rows for 0.9 at similarity 0.5, which is 0.977 at 0.55, 0.997 at 0.6
and 0.999999 at 0.7, while two notes that merely share turns of phrase (0.1)
become candidates with probability 0.0007.

Verification sends each text of a candidate pair as its list of 32-bit word
hashes and compares 64-bit hashes of the word runs.

Equal texts (equal sequences of words) are one text throughout, named by a
64-bit fingerprint: copies are merged within each task before the exchange, so
a group of copies holding a third of all rows sends one row per task and band.
Members of that group are expanded only in the result that asks for them, in
blocks.

Null, blank and too short texts (less than ``k`` words) are in no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.llm import shingles
from noteweave.llm.pairing import pairs_sharing_key, pairs_within
from noteweave.session import cut_lineage

BATCH_CHARS = 1 << 20
U = np.uint64


def choose_bands(least: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` rows that make a pair at similarity ``least`` a candidate with probability ``recall``."""
    if least >= 1:
        return 1, rows
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows)), rows


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of a column's texts of about ``BATCH_CHARS`` characters, with the place of the first."""
    texts: list[str] = []
    size = at = 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= BATCH_CHARS:
            yield at, texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield at, texts


def _bands(k: int, bands: int, rows: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, texts in chunks(b.column("text")):
                w = shingles.words(texts)
                sig, ids = shingles.minhash(w, k, bands * rows)
                if not len(ids):
                    continue
                fp = w.fingerprints()[ids]
                fresh = np.array([not (f in seen or seen.add(f)) for f in fp.tolist()], bool)
                keys = shingles.band_keys(sig[fresh], bands, rows)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "id": np.repeat(fp[fresh], bands)})

    return run


def _prints(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, enough = [], []
            for _, texts in chunks(b.column("text")):
                w = shingles.words(texts)
                prints.append(w.fingerprints())
                enough.append(w.counts() >= k)
            if prints:
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "fp": pa.array(np.concatenate(prints)), "enough": np.concatenate(enough)})

    return run


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, w): each different text of a task as its list of word hashes, 4 bytes a word."""
    seen: set[int] = set()
    for b in batches:
        for _, texts in chunks(b.column("text")):
            w = shingles.words(texts)
            packed = (w.hashes >> U(32)).astype(np.uint32).tobytes()
            fp, out = [], []
            for i, f in enumerate(w.fingerprints().tolist()):
                if f and f not in seen:
                    seen.add(f)
                    fp.append(f)
                    out.append(packed[4 * w.offsets[i] : 4 * w.offsets[i + 1]])
            yield pa.RecordBatch.from_pydict({"fp": pa.array(fp, pa.int64()), "w": pa.array(out, pa.binary())})


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a column of lists, and where each list begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint32)[offsets[0] // 4 : offsets[-1] // 4], (offsets - offsets[0]) // 4


def run_sets(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of ``k`` words of each list as 64-bit hashes that carry the list's number, that number, and the hashes of the runs alone."""
    h, row = shingles.Words(shingles.mix(words.astype(np.uint64)), offsets.astype(np.int64)).windows(k)
    named, first = np.unique(shingles.mix(h ^ shingles.mix(row.astype(np.uint64) + U(1))), return_index=True)
    return named, row[first], h[first]


def jaccard(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray, k: int) -> np.ndarray:
    """Similarity of two columns of word lists, row by row, as sets of runs of ``k`` words."""
    n = len(xo) - 1
    (a, i, _), (b, j, _) = run_sets(x, xo, k), run_sets(y, yo, k)
    common = np.bincount(i[np.isin(a, b, assume_unique=True)], minlength=n)
    union = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) - common
    return common / np.maximum(union, 1)


def _verify(k: int, least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                s = jaccard(*ragged(p.column("wa")), *ragged(p.column("wb")), k)
                keep = s >= least
                yield pa.RecordBatch.from_pydict({"a": p.column("a").filter(pa.array(keep)), "b": p.column("b").filter(pa.array(keep)), "similarity": s[keep]})

    return run


def fingerprints(df: DataFrame, text: str, id: str, k: int = 3) -> DataFrame:
    """One row (id, fp, enough) per row of ``df``; ``enough``: the text has ``k`` words or more."""
    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_prints(k), f"id {kind}, fp long, enough boolean")


def with_word_lists(candidates: DataFrame, texts: DataFrame, make=word_lists) -> DataFrame:  # noqa: ANN001
    """Candidate pairs (a, b, ...) of fingerprints with their texts' word lists ``wa`` and ``wb``. ``make``: gives the lists of the texts of a pair, at least."""
    needed = candidates.select(F.col("a").alias("fp")).union(candidates.select("b")).distinct()
    lists = texts.mapInArrow(make, "fp long, w binary").join(needed, "fp", "left_semi").groupBy("fp").agg(F.first("w").alias("w"))
    one = candidates.join(lists.select(F.col("fp").alias("a"), F.col("w").alias("wa")), "a")
    return one.join(lists.select(F.col("fp").alias("b"), F.col("w").alias("wb")), "b")


def similar_texts(df: DataFrame, text: str, k: int = 5, least: float = 0.8, recall: float = 0.95) -> DataFrame:
    """Pairs (a, b, similarity) of different texts' fingerprints, a < b, at ``least`` or more.

    Two exchanges, of band keys and of word lists, both spread by hash of the text.
    ``recall``: the share of pairs at ``least`` that become candidates; higher above it.
    """
    texts = df.select(F.col(f"`{text}`").alias("text")).filter("text is not null")
    candidates = cut_lineage(pairs_sharing_key(texts.mapInArrow(_bands(k, *choose_bands(least, recall)), "key long, id long")))
    return with_word_lists(candidates, texts).select("a", "b", "wa", "wb").mapInArrow(_verify(k, least), "a long, b long, similarity double")


def similar_records(df: DataFrame, text: str, id: str, k: int = 5, least: float = 0.8, recall: float = 0.95) -> DataFrame:
    """Pairs (id_a, id_b), a < b, of different ids whose texts are equal or similar.

    Ids that repeat with the same text count once. This lists every pair within
    a group; ``similar_groups`` names each record's group instead, in one row.
    """
    member = cut_lineage(fingerprints(df, text, id, k).filter("enough and id is not null").select("fp", "id").distinct())
    links = cut_lineage(similar_texts(df, text, k, least, recall).select("a", "b"))
    x, y = member.select(F.col("fp").alias("a"), F.col("id").alias("x")), member.select(F.col("fp").alias("b"), F.col("id").alias("y"))
    near = links.join(x, "a").join(y, "b")
    equal = pairs_within(member, "fp", "id").toDF("x", "y")
    both = near.select("x", "y").unionByName(equal).filter("x != y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The least node (``root``) of each node's connected component.

    Alternates joining every node to the least of its neighbours' roots with
    pointer jumping, and writes each round to the shared folder; stops when no
    root changes. Only the count of changes comes to the driver.
    """
    edges = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    roots = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root")))
    for _ in range(rounds):
        near = edges.join(roots.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        lower = roots.join(near, "u").select("u", F.least("root", "r").alias("next"), F.col("root").alias("old"))
        jump = lower.join(roots.select(F.col("u").alias("next"), F.col("root").alias("far")), "next")
        new = cut_lineage(jump.select("u", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("old")).alias("moved")))
        roots = new.select("u", "root")
        if not new.filter("moved").limit(1).count():
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def similar_groups(df: DataFrame, text: str, id: str, k: int = 5, least: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row (id, class_id, links) per row of ``df``.

    ``class_id`` is equal for texts joined by a chain of similar ones; null for
    texts that are null, blank or too short. ``links``: how many other different
    texts are directly similar.
    """
    prints = fingerprints(df, text, id, k)
    pairs = cut_lineage(similar_texts(df, text, k, least, recall).select("a", "b"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    info = components(pairs).withColumnRenamed("u", "fp").join(degree, "fp")
    joined = prints.join(info, "fp", "left")
    return joined.select("id", F.when(F.col("enough"), F.coalesce("root", "fp")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
