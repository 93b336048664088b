"""Containers of fixed capacity filled with documents of varying length.

The plan is made on the histogram of lengths, not on documents: it has at most
one row per length up to the capacity, so the driver's share is bounded by the
capacity however many documents there are. Best fit, longest first, places a
whole run of equal lengths at once into all containers that have the same room
left. The plan says, for each length, which ranks go to which containers; each
document then finds its slot by its rank among documents of its length.

Ranks within a length are counted in two steps, within pieces by hash and over
the pieces' sizes, so a length that a third of the documents share is ranked by
many tasks.

A document longer than the capacity is cut into full containers and a rest,
which is packed like any other. Null and empty documents take no room and are in
no container. Ties are settled by the hash and value of the id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.session import cut_lineage

PIECES = 64


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first container, place in container), by length and rank.

    Best-fit decreasing over counts: a step fills containers of equal room with
    one item each. Steps are bounded by lengths and items per container, not by
    the number of items.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # the different amounts of room left, ascending
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room: (first container, containers, items in each)
    bins = 0

    def add(room: int, group: tuple[int, int, int]) -> None:
        if room <= 0:
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(group)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                opened = -(-left // (capacity // length))
                add(capacity, (bins, opened, 0))
                bins += opened
                continue
            room = rooms[i]
            first, count, items = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            used = min(left, count)
            rows.append((length, rank, used, first, items))
            add(room - length, (first, used, items + 1))
            if used < count:
                add(room, (first + used, count - used, items))
            rank, left = rank + used, left - used
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _slots(steps: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            key = lambda a, r: a * (1 << 40) + r  # noqa: E731  # lengths are at most the capacity
            at = np.searchsorted(key(steps[:, 0], steps[:, 1]), key(length, rank), "right") - 1
            s = steps[at]
            columns = [b.column(c) for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], names=[*(c for c in b.schema.names if c != "rank"), "bin", "place"])

    return run


def rank_within(df: DataFrame, group: str, id: str) -> DataFrame:
    """Adds ``rank`` (from 0) within ``group``; no task holds a whole group."""
    d = df.withColumn("_piece", F.pmod(F.xxhash64(id), F.lit(PIECES)).cast("int"))
    sizes = d.groupBy(group, "_piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(group, "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(group, "_piece").orderBy(F.col(id))) - 1
    return d.withColumn("_local", local).join(offsets, [group, "_piece"]).withColumn("rank", (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", "_piece")


def pack(sizes: DataFrame, id: str, capacity: int) -> DataFrame:
    """(container, id, piece, n_tokens, place) for ``sizes`` (id, n_tokens).

    ``container`` is unique; ``place`` is the order in it, from 0; ``piece`` is 0
    unless a document was cut. Pieces of a cut document fill containers of their
    own, named after it. ``sizes`` is read several times: write it first.
    """
    some = sizes.filter("n_tokens > 0").select(F.col(id), "n_tokens")
    cap = F.lit(capacity).cast("long")
    whole = (
        some.filter(F.col("n_tokens") > cap)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n_tokens div {capacity} - 1"))))
        .select(F.concat(F.lit("d"), F.col(id), F.lit("."), F.col("piece")).alias("container"), id, "piece", cap.alias("n_tokens"), F.lit(0).cast("long").alias("place"))
    )
    rest = some.select(id, F.when(F.col("n_tokens") > cap, F.expr(f"n_tokens div {capacity}")).otherwise(F.lit(0).cast("long")).alias("piece"), F.when(F.col("n_tokens") > cap, F.col("n_tokens") % cap).otherwise(F.col("n_tokens")).alias("n_tokens")).filter("n_tokens > 0")
    histogram = {r["n_tokens"]: r["n"] for r in rest.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    steps = plan(histogram, capacity)
    ranked = rank_within(rest, "n_tokens", id)
    kind = sizes.schema[id].dataType.simpleString()
    placed = ranked.select(id, "piece", "n_tokens", "rank").mapInArrow(_slots(steps), f"`{id}` {kind}, piece long, n_tokens long, bin long, place long")
    return placed.select(F.concat(F.lit("b"), F.col("bin")).alias("container"), id, "piece", "n_tokens", "place").unionByName(whole)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and the share of room left unused."""
    filled = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return filled.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(1 - F.sum("t") / (F.count("*") * F.lit(capacity)), 6).alias("unused_share"),
    )


def written_sizes(sizes: DataFrame) -> DataFrame:
    return cut_lineage(sizes)
