import numpy as np
from noteweave.llm import toxicity


def test_threshold_is_fitted_on_every_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LABELS", 5, raising=False)  # the earlier cap
    used = []
    real = toxicity.best_threshold

    def best(scores, toxic, n=None):
        used.append(len(scores) if n is None else int(n.sum()))
        return real(scores, toxic) if n is None else real(scores, toxic, n)

    monkeypatch.setattr(toxicity, "best_threshold", best)
    df = spark.createDataFrame([(i, "you dumb bastard, I will kill you" if i % 3 == 0 else "Xét nghiệm bình thường.") for i in range(60)], "doc long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc long, toxic int")
    toxicity.fit(df, "text", "doc", labels)
    assert used == [60]


def test_threshold_from_counts():
    rng = np.random.default_rng(4)
    scores, toxic = np.concatenate([rng.random(500), toxicity.GRID]), np.concatenate([rng.random(500) < 0.5, toxicity.GRID > 0.6])
    step = np.searchsorted(toxicity.GRID, scores, "right")
    pairs, n = np.unique(np.stack([step, toxic]), axis=1, return_counts=True)
    assert toxicity.best_threshold(np.concatenate([[0.0], toxicity.GRID])[pairs[0]], pairs[1] > 0, n) == toxicity.best_threshold(scores, toxic)
