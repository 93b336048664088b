"""Records of several sources mixed to target shares of the total size.

The total is the largest at which no source needs more than its capped number
of repeats. A source's budget is filled by complete epochs first, the rest by
Efraimidis-Spirakis sampling without replacement: each document has the key
-ln(u) / weight, with u uniform by hash of its id and the weight its quality;
documents are taken by ascending key while their sizes sum up to the budget. A
document that does not fit what is left is passed over and the draw goes on
behind it. When no document of the pass fits any more, those that may be used
again enter another pass with fresh keys, up to their source's cap.

Everything about a draw is a short list per source: the pass, the stretch of
keys it covers and the most that was left. A document's uses follow from its own
key and size and that list, so drawing rewrites no table and joins none.

The end of a stretch is found without sorting a source in one task: keys are
spread over ``CELLS`` cells, equally likely ones whatever the weights (by the
source's own mix of weights); cell totals are summed in order (at most ``CELLS``
rows a source), and only the documents of the cell where the budget ends are
sorted.

A source without documents gets nothing, and the others share its part in
proportion. A source whose documents are too long to fill its budget lowers the
total for all if it reaches at least a quarter of it (``LOWEST``); otherwise it stays
short, and the report says by how much and why. Documents without tokens or of
an unlisted or null source are not used (0 uses). Null or non-positive weights
count as 0.1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 4096
CLASSES = 10
LOWEST = 0.25
#: A source's draw ends when this share of its budget is left.
CLOSE = 0.0005
ROUNDS = 200


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: the share of letters times the variety of words, as built-in expressions."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    words = F.split(F.trim(text), r"\s+")
    variety = F.sqrt(F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
    return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(1.0), letters * variety)), F.lit(0.1))


def _weight() -> Column:
    return F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.1)


def _key(id: Column, seed: int, turn: Column) -> Column:
    u = (F.pmod(F.xxhash64(id, turn + seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / _weight()


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its tokens, corrected share, budget and the mix of its weights in ``CLASSES`` classes."""
    place = F.least(F.greatest(F.ceil(_weight() * CLASSES), F.lit(1)), F.lit(CLASSES))
    mixture = F.array(*(F.avg((place == i).cast("int")) for i in range(1, CLASSES + 1)))
    have = sizes.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), mixture.alias("mixture"))
    t = targets.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = W.partitionBy(F.lit(1))
    live = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("target_share"))
    t = t.withColumn("share", F.coalesce(live / F.sum(live).over(everything), F.lit(0.0)))
    room = F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))
    return t.withColumn("total", F.min(room).over(everything)).withColumn("budget", F.coalesce(F.col("share") * F.col("total"), F.lit(0.0)))


class _Source:
    """What is known of one source while its budget is being filled."""

    def __init__(self, row, budget: float) -> None:  # noqa: ANN001
        self.name, self.tokens, self.cap, self.mixture = row["source"], row["tokens"], row["max_repeats"], row["mixture"]
        self.budget = budget
        self.epochs = min(int(budget / self.tokens + 1e-12), self.cap) if self.tokens else 0
        self.rest = max(budget - self.epochs * self.tokens, 0.0)
        self.turn, self.low = 0, -1.0
        self.stretches: list[tuple[int, float, float, float]] = []

    def open(self) -> bool:
        return self.rest > max(CLOSE * self.budget, 0) and self.rest >= 1 and self.epochs + self.turn < self.cap


def _small(spark, sources: list[_Source]):  # noqa: ANN001, ANN202
    rows = [(s.name, s.epochs, s.turn, s.low, s.rest, [float(x) for x in s.mixture or [0.0] * CLASSES]) for s in sources]
    return F.broadcast(spark.createDataFrame(rows, "source string, epochs int, turn int, low double, rest double, mixture array<double>"))  # one row a target


def _fill(sizes: DataFrame, id: str, seed: int, sources: list[_Source]) -> None:
    """Finds each source's stretches. A round costs two passes over the narrow table and brings one row a source to the driver."""
    spark = sizes.sparkSession
    for _ in range(ROUNDS):
        live = [s for s in sources if s.open()]
        if not live:
            return
        spread = sum((F.col("mixture")[i - 1] * (1 - F.exp(-F.col("_key") * (i / CLASSES))) for i in range(1, CLASSES + 1)), F.lit(0.0))
        d = sizes.join(_small(spark, live), "source").withColumn("_key", _key(F.col(id), seed, F.col("turn")))
        d = d.filter("n_tokens > 0 and n_tokens <= rest and _key > low").withColumn("_cell", F.least(F.floor(spread * CELLS), F.lit(CELLS - 1)).cast("int"))
        cells = d.groupBy("source", "_cell").agg(F.sum("n_tokens").alias("t"), F.min("_key").alias("first"), F.max("rest").alias("rest"))
        upto = F.sum("t").over(W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))
        placed = cells.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("rest"))
        ends = placed.groupBy("source").agg(F.sum("t").alias("all"), F.min(F.when(F.col("over"), F.struct("_cell", "first", (F.col("upto") - F.col("t")).alias("before")))).alias("cut"))
        at = {r["source"]: r for r in ends.collect()}
        cuts = [(n, r["cut"]["_cell"], float(r["cut"]["before"])) for n, r in at.items() if r["cut"]]
        inside = {}
        if cuts:
            named = F.broadcast(spark.createDataFrame(cuts, "source string, _cell int, before double"))
            running = F.sum("n_tokens").over(W.partitionBy("source").orderBy("_key").rangeBetween(W.unboundedPreceding, 0))
            fits = d.join(named, ["source", "_cell"]).withColumn("upto", F.col("before") + running).filter("upto <= rest")
            inside = {r["source"]: r for r in fits.groupBy("source").agg(F.max("_key").alias("high"), F.max("upto").alias("upto")).collect()}
        for s in live:
            if s.name not in at:  # nothing of this pass fits
                s.turn, s.low = s.turn + 1, -1.0
                if s.turn and not any(t == s.turn - 1 for t, *_ in s.stretches):
                    s.turn = s.cap  # nor did anything in the whole pass: another would be the same
                continue
            r, most = at[s.name], s.rest
            if not r["cut"]:
                high, taken = math.inf, float(r["all"])
            elif s.name in inside:
                high, taken = inside[s.name]["high"], inside[s.name]["upto"]
            else:
                high, taken = float(np.nextafter(r["cut"]["first"], -1)), r["cut"]["before"]
            s.stretches.append((s.turn, s.low, high, most))
            s.rest -= taken
            if high == math.inf:
                s.turn, s.low = s.turn + 1, -1.0
            else:
                s.low = high
    return


def mix(sizes: DataFrame, targets: DataFrame, id: str, seed: int = 11) -> DataFrame:
    """Adds ``uses`` to ``sizes`` (id, source, n_tokens, weight). ``targets``: source, target_share, max_repeats (fixed, small).

    ``sizes`` is read several times: write it first.
    """
    spark = sizes.sparkSession
    known = [r for r in budgets(sizes, targets).collect() if r["share"] > 0]  # one row a target
    total = min((r["total"] for r in known), default=0.0)
    sources: list[_Source] = []
    for _ in range(8):
        sources = [_Source(r, r["share"] * total) for r in known]
        _fill(sizes, id, seed, sources)
        reached = [(s.budget - s.rest) / s.budget for s in sources if s.budget > 0]
        low = min((x for x in reached if x >= LOWEST), default=1.0)
        if low >= 0.998:
            break
        total *= low
    plan = [(s.name, s.epochs, s.stretches) for s in sources]
    shape = "source string, epochs int, stretches array<struct<turn:int,low:double,high:double,most:double>>"
    d = sizes.join(F.broadcast(spark.createDataFrame(plan, shape)), "source", "left")
    drawn = F.filter("stretches", lambda s: (_key(F.col(id), seed, s["turn"]) > s["low"]) & (_key(F.col(id), seed, s["turn"]) <= s["high"]) & (F.col("n_tokens") <= s["most"]))
    uses = F.when(F.coalesce(F.col("n_tokens"), F.lit(0)) > 0, F.coalesce(F.col("epochs") + F.size(drawn), F.lit(0))).otherwise(0)
    return d.withColumn("uses", uses.cast("int")).drop("epochs", "stretches")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target share, that share corrected for sources without documents, actual share of all tokens drawn, documents, most uses, and why it is short, if it is."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count_if(F.col("uses") > 0).alias("docs_used"), F.max("uses").alias("most_uses"), F.sum("n_tokens").alias("_have")
    )
    t = targets.join(got, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
    everything = W.partitionBy(F.lit(1))
    live = F.when((F.coalesce("_have", F.lit(0)) > 0) & (F.col("target_share") > 0), F.col("target_share"))
    wanted = F.coalesce(live / F.sum(live).over(everything), F.lit(0.0))
    actual = F.coalesce(F.col("tokens_used") / F.sum("tokens_used").over(everything), F.lit(0.0))
    why = F.when(F.coalesce("_have", F.lit(0)) == 0, "no documents").when(actual < 0.99 * wanted, "no document fits the rest under the cap").otherwise("")
    return t.select(
        "source", "target_share", F.round(wanted, 6).alias("corrected_share"), F.round(actual, 6).alias("actual_share"), "tokens_used",
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats", why.alias("shortfall"),
    )
