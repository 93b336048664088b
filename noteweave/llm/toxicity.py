"""Abusive, hateful or sexually harassing language, by weak supervision.

Sentences are the unit, as abuse stands amid clinical text. Many voters, each a
lexicon or a pattern, fire on a sentence or not. A generative label model with a
hidden class fits how often each voter is right, by expectation
maximisation over the counts of voting patterns of all sentences (at most two to
the number of voters rows, whatever the corpus); pairs of voters that still
agree within a class are taken as correlated and their votes weigh less. A
linear classifier on hashed words and word pairs then learns the posteriors, on
a sample of at most ``SAMPLE`` sentences of either kind, chosen by hash. Every
sentence of every document is scored by it; a document's score is the highest of
its sentences. The threshold is the one that agrees best with reviewers' labels,
all of them: labelled documents are counted by label and step of the score.

A null, empty or blank document has score 0. Repeated texts count each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.llm import shingles
from noteweave.llm.canon import canonical
from noteweave.llm.neardup import BATCH_CHARS
from noteweave.llm.pii import fold

SAMPLE = 30_000
NEGATIVE_RATE = 16
GRID = np.round(np.arange(0.05, 0.96, 0.01), 2)
BITS = 18

SENTENCE = re.compile(r"\n+|(?<=[.!?;])\s+")
STRETCHED = re.compile(r"([a-z])\1{2,}")
SPELLED = re.compile(r"(?<![a-z0-9])[a-z](?:[._*\- ]+[a-z](?![a-z])){2,}(?![a-z0-9])")
MASKED = re.compile(r"(?<![a-z0-9])[a-z]{1,6}(?:[*@$_#]{1,3}[a-z]{1,4})+(?![a-z0-9])")

# Lexicons and patterns of the voters, on lower case without accents. True: speaks for abuse.
VOTERS: list[tuple[str, bool, str]] = [
    ("insult_vi", True, r"(?<!sau )\b(?:khon nan|khon kiep|do khon|cho ma|cho chet|oc cho|con di(?! cau)|thang hen|thang ngu|ngu nhu bo|(?:la|da|may|thang|bon|lu|,) do (?:dien|cho|ngu|ton|hen)(?! chap| tim)|vo hoc|mat day|de tien|thoi tha|rac ruoi|dau dat|con lon|an hai|suc vat|mat dai|ha cap|con mu|lao toet|vo lai|bo lao)\b"),
    ("insult_en", True, r"\b(?:bastard|bitch|scumbag|scum|trash|jerk|loser|slob|stupid cow|moron|idiot|dumb|disgusting|arrogant|lying|filthy|pig|worthless|imbecile|asshole|retard)\b"),
    ("curse", True, r"\b(?:me kiep|burn in hell|die alone|hope you die|go to hell|do chet|chet di|chet quach|damn you|fuck\w*|dit me|vcl)\b"),
    ("vulgar_you", True, r"\b(?:chung may|tui bay|bon may|tao (?:ma|ve|dap|khinh|chem|giet|khoe|thu)|(?:cho|mat|voi|nha|la) tao(?! bon)|may (?:do|con|thang|la do)|mom (?:may|chung)|thang bao ve|con mu|dua nhap)\b"),
    ("threat_vi", True, r"\b(?:dap nat|dam vao mat|la tao chem|chem chet|giet (?:may|chung|ca)|xu tung dua|danh chet|nho vao mat|cut khoi|dep di|cam mom|ngoai duong la|no sung|dot nha)\b"),
    ("threat_en", True, r"\b(?:break your|will bleed|where (?:she|he|you) (?:parks|park|lives|live)|shut your|kill you|burn (?:this|your)|you will pay|make you sick|smash your)\b"),
    ("contempt_vi", True, r"\b(?:khong phai la nguoi|sinh ra da|benh day nguoi|lam trau ngua|tong het|duoi het|ban thiu|phi thuoc|dung chua cho|giong ay|toan bon|nhin la muon|khong bang con vat|khong dang song)\b"),
    ("contempt_en", True, r"\b(?:are vermin|vermin|thrown out|are animals|do not deserve|like you should|should never touch|subhuman|go back where|breed like|infest|one more of|throw (?:it|them) out)\b"),
    ("harass_vi", True, r"\b(?:anh nen|lam tinh|chich|bu cho|coi ao|cho anh (?:so|xem|luon|om|hon)|anh vu|de em|muon de|mong em|nguc to|nam xuong day|ngu voi anh)\b"),
    ("harass_en", True, r"\b(?:naked|your tits|grab your|screw her|bend that|your ass|sexy|strip for|sleep with me|kiss me|take off that|sit on my)\b"),
    ("aimed", True, r"\b(?:dung la do|dung la|y ta|em dieu duong|co dieu duong|dua nhap ho so|thang bao ve|con mu truc|cow|you|your|that nurse|viet benh an)\b.*(?:!|\b(?:chu|di|luon|nhe|tao|anh|sick|hell|teeth|alone|bleed)\b)"),
    ("masked", True, r"MASKED|SPELLED|STRETCHED"),
    ("clinical", False, r"\d ?(?:mg|ml|mmol|g/l|u/l|ng|kg|cm|%|lan|phut|gio|thang|ngay|days|hours)|\b(?:kham thay|sieu am|xet nghiem|dien tim|chan doan|dieu duong ghi nhan|benh khoi phat|tap van|exam|normal|ward doctor|review|follow|plan|imaging|theo doi)\b"),
    ("report", False, r"\b(?:ke rang|bi chong|loi phan nan|nhan vien xa hoi|apologi[sz]ed|fears|felt|reports|denies|asked whether|tu y|than|noi rang|hoi tam than|co loi)\b"),
    ("organs", False, r"\b(?:am dao|duong vat|co tu cung|nipple|discharge|ky kinh|tinh duc deu|xuat tinh|phu khoa|hau mon|bao cao su|breast exam|testic\w*|pelvic|truc trang)\b"),
]
_PATTERNS = [re.compile(p) for _, _, p in VOTERS]
FOR = np.array([t for _, t, _ in VOTERS])
FOR_BITS = sum(1 << i for i, (_, t, _) in enumerate(VOTERS) if t)


def sentences(text: str) -> list[str]:
    """A text's sentences, folded; stretched, spelled-out and masked words are spelled plainly and marked."""
    return [_plain(s) for s in SENTENCE.split(fold(canonical(text))) if s.strip()]


def _plain(f: str) -> str:
    marks = ""
    if MASKED.search(f):
        marks += " MASKED"
    if STRETCHED.search(f):
        f, marks = STRETCHED.sub(r"\1", f), marks + " STRETCHED"
    if SPELLED.search(f):
        f, marks = SPELLED.sub(lambda m: re.sub(r"[^a-z]", "", m[0]), f), marks + " SPELLED"
    return f + marks


def votes(folded: str) -> int:
    """The voters that fire, as bits."""
    bits = 0
    for i, p in enumerate(_PATTERNS):
        if p.search(folded):
            bits |= 1 << i
    return bits


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared = Counter()
    for b in batches:
        masks, texts = [], []
        for t in b.column("text").to_pylist():
            for f in sentences(t or ""):
                m = votes(f)
                shared[m] += 1
                if m & FOR_BITS or hash_text(f) % NEGATIVE_RATE == 0:
                    masks.append(m)
                    texts.append(f)
        yield pa.RecordBatch.from_pydict({"mask": pa.array(masks, pa.int64()), "n": pa.array([0] * len(masks), pa.int64()), "sentence": pa.array(texts, pa.string())})
    keys = list(shared)
    yield pa.RecordBatch.from_pydict({"mask": pa.array(keys, pa.int64()), "n": pa.array([shared[k] for k in keys], pa.int64()), "sentence": pa.array([None] * len(keys), pa.string())})


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


@dataclass
class LabelModel:
    """How often each voter is right, how much its vote weighs beside correlated ones, and the share of abuse among sentences that a voter calls it."""

    accuracy: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    share: float

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """The probability of abuse. A voter that doesn't fire says nothing; where none speaks for abuse it is next to none."""
        side = np.where(FOR, 1.0, -1.0) * np.log(self.accuracy / (1 - self.accuracy)) * self.weight
        odds = np.log(self.share / (1 - self.share)) + fired @ side
        return np.where((fired * FOR).any(axis=1), 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0.001)


def bits(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)


def fit_label_model(masks: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over counts of voting patterns."""
    fired = bits(masks)
    n = counts.astype(float)
    covered = (fired * FOR).any(axis=1)
    belief = np.where(FOR, 0.85, 0.75)
    model = LabelModel(belief.copy(), np.ones(len(VOTERS)), np.eye(len(VOTERS)), 0.5)
    for r in range(rounds):
        p = model.posterior(fired)
        right = np.where(FOR, p[:, None], 1 - p[:, None])
        seen = (n * covered) @ fired
        hits = (n * covered) @ (fired * right)
        # a belief that counts as much as half the votes keeps the two classes from changing places
        model.accuracy = np.clip((hits + (0.5 * seen + 2) * belief) / (1.5 * seen + 2), 0.05, 0.995)
        model.share = float(np.clip((n * covered) @ p / max((n * covered).sum(), 1), 0.05, 0.95))
        if r % 10 == 9:  # agreement beyond what the class explains
            one = n * covered * p
            centred = fired - one @ fired / max(one.sum(), 1)
            cov = (centred * one[:, None]).T @ centred / max(one.sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            model.correlation = cov / sd[:, None] / sd[None, :]
            extra = np.where(model.correlation > 0.2, model.correlation, 0) * (1 - np.eye(len(VOTERS)))
            model.weight = 1 / (1 + extra.sum(axis=1))
    return model


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of each text, as numbers of ``BITS`` bits, and where each text begins."""
    w = shingles.words(texts)
    pair, doc = w.windows(2)
    ids = np.concatenate([w.hashes >> np.uint64(64 - BITS), pair >> np.uint64(64 - BITS)])
    owner = np.concatenate([np.repeat(np.arange(len(texts)), w.counts()), doc])
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(texts) + 1))


def train(texts: list[str], target: np.ndarray, epochs: int = 25, rate: float = 1.0, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression by Adagrad on soft labels; the last weight is the intercept."""
    ids, offsets = features(texts)
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 256):
            part = order[a : a + 256]
            n = offsets[part + 1] - offsets[part]
            row = np.repeat(np.arange(len(part)), n)
            f = ids[np.repeat(offsets[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            scale = 1 / np.sqrt(np.maximum(n, 1))
            z = np.bincount(row, w[f], minlength=len(part)) * scale + w[-1]
            g = 1 / (1 + np.exp(-z)) - target[part]
            grad = np.bincount(f, (g * scale)[row], minlength=len(w))
            grad[-1] = g.sum()
            touched = np.flatnonzero(grad)
            step = grad[touched] / len(part) + decay * w[touched]
            seen[touched] += step**2
            w[touched] -= rate * step / np.sqrt(seen[touched])
    return w.astype(np.float32)


def _scores(weights: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(b.num_rows)
            part: list[str] = []
            owner: list[int] = []
            size = 0

            def flush() -> None:
                if not part:
                    return
                ids, offsets = features(part)
                total = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
                n = np.diff(offsets)
                z = (total[offsets[1:]] - total[offsets[:-1]]) / np.sqrt(np.maximum(n, 1)) + weights[-1]
                np.maximum.at(score, owner, np.where(n > 0, 1 / (1 + np.exp(-z)), 0))

            for i, t in enumerate(b.column("__text").to_pylist()):
                for f in sentences(t or ""):
                    part.append(f)
                    owner.append(i)
                    size += len(f)
                if size > BATCH_CHARS:
                    flush()
                    part, owner, size = [], [], 0
            flush()
            names = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return run


@dataclass
class Detector:
    label_model: LabelModel
    weights: np.ndarray
    threshold: float


def score(df: DataFrame, text: str, keep: list[str], weights: np.ndarray) -> DataFrame:
    """Columns ``keep`` and ``score``, of every row. One pass, no shuffle."""
    chosen = df.select(*keep, F.col(f"`{text}`").alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "__text")
    return chosen.mapInArrow(_scores(weights), f"{shape}, score double")


def fit(df: DataFrame, text: str, id: str, labels: DataFrame) -> Detector:
    """Label model, classifier and threshold. ``labels``: id, toxic (0 or 1), several per document allowed."""
    voted = df.select(F.col(f"`{text}`").alias("text")).filter("text is not null").mapInArrow(_vote_rows, "mask long, n long, sentence string")
    from noteweave.session import cut_lineage

    voted = cut_lineage(voted)
    counts = voted.filter("sentence is null").groupBy("mask").agg(F.sum("n").alias("n")).collect()  # at most 2 ** voters rows
    masks, n = np.array([r["mask"] for r in counts] or [0], np.int64), np.array([r["n"] for r in counts] or [1])
    model = fit_label_model(masks, n)
    posterior = model.posterior(bits(masks))
    positive = [int(m) for m, p in zip(masks, posterior, strict=True) if p >= 0.5]
    some = voted.filter("sentence is not null").dropDuplicates(["sentence"])
    chosen = F.col("mask").isin(positive) if positive else F.lit(False)
    texts: list[str] = []
    target: list[float] = []
    known = dict(zip(masks.tolist(), posterior.tolist(), strict=True))
    for side in (chosen, ~chosen):
        rows = some.filter(side).orderBy(F.xxhash64("sentence"), "sentence").limit(SAMPLE).select("sentence", "mask").collect()
        texts += [r["sentence"] for r in rows]
        target += [known[r["mask"]] for r in rows]
    weights = train(texts, np.array(target)) if texts else np.zeros((1 << BITS) + 1, np.float32)
    judged = labels.groupBy(F.col(id)).agg(F.avg("toxic").alias("toxic")).filter("toxic != 0.5")
    scored = score(df.join(judged, id), text, ["toxic"], weights).mapInArrow(_steps, "step int, bad boolean, n long")
    rows = scored.groupBy("step", "bad").agg(F.sum("n").alias("n")).collect()  # at most two for each step of the grid
    lows = np.concatenate([[0.0], GRID])
    return Detector(model, weights, best_threshold(lows[[r["step"] for r in rows]], np.array([r["bad"] for r in rows], bool), np.array([r["n"] for r in rows], np.int64)))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each label lie at each step: the number of thresholds that the score reaches."""
    n = np.zeros((len(GRID) + 1, 2), np.int64)
    for b in batches:
        step = np.searchsorted(GRID, b.column("score").to_numpy(), "right")
        np.add.at(n, (step, (b.column("toxic").to_numpy() > 0.5).astype(int)), 1)
    step, bad = np.nonzero(n)
    yield pa.RecordBatch.from_pydict({"step": step.astype(np.int32), "bad": bad > 0, "n": n[step, bad]})


def best_threshold(scores: np.ndarray, toxic: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of the best F1, in the middle of the range that reaches it; 0.5 without positive labels. ``n``: how often each row counts."""
    if not toxic.any():
        return 0.5
    n = np.ones(len(scores), np.int64) if n is None else n
    grid = GRID
    hit = np.array([n[toxic & (scores >= g)].sum() for g in grid])
    f1 = 2 * hit / (np.array([n[scores >= g].sum() for g in grid]) + n[toxic].sum())
    best = grid[f1 >= f1.max() - 1e-12]
    return float(best[len(best) // 2])
