"""Pairs of rows that share a key, without an unbounded group in any task.

Rows are exchanged and sorted by key, then each sorted partition is streamed:
memory holds one key's ids, and only up to ``block``. A larger group's rows are
handed on instead, spread over a square of block pairs by hash, as many blocks as
its size asks for, and joined there in many tasks. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.session import cut_lineage

BLOCK = 1 << 10


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, columns: list[str], most: int) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    """Cuts a stream sorted by key into (False, keys, columns) of whole groups and (True, keys, columns) of parts of groups larger than ``most``."""
    held: list[np.ndarray] | None = None
    hot = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in [key, *columns]]
        if hot is not None:
            n = int(np.searchsorted(new[0], hot, "right"))
            if n:
                yield True, new[0][:n], [x[:n] for x in new[1:]]
                new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            hot = None
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1], "left"))
        if last:
            yield from _parts(held[0][:last], [x[:last] for x in held[1:]], most)
            held = [x[last:] for x in held]
        if len(held[0]) > most:
            hot = held[0][-1]
            yield True, held[0], held[1:]
            held = None
    if held is not None:
        yield False, held[0], held[1:]


def _parts(keys: np.ndarray, columns: list[np.ndarray], most: int) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    offsets = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    big = np.repeat(np.diff(offsets) > most, np.diff(offsets))
    if big.any():
        yield True, keys[big], [x[big] for x in columns]
    if not big.all():
        yield False, keys[~big], [x[~big] for x in columns]


def group_pairs(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within each group, group sizes being moderate."""
    sizes = np.diff(offsets)
    left, right = [], []
    for m in np.unique(sizes[sizes > 1]):
        at = offsets[:-1][sizes == m]
        i, j = np.triu_indices(m, 1)
        left.append((at[:, None] + i[None, :]).ravel())
        right.append((at[:, None] + j[None, :]).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hot, keys, (ids,) in sorted_groups(batches, "key", ["id"], BLOCK):
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        k, v = keys[fresh], ids[fresh]
        if hot:
            yield pa.RecordBatch.from_pydict({"a": v, "b": k, "whole": np.zeros(len(v), bool)})
            continue
        offsets = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        i, j = group_pairs(offsets)
        for at in range(0, len(i), 1 << 17):
            x, y = v[i[at : at + (1 << 17)]], v[j[at : at + (1 << 17)]]
            yield pa.RecordBatch.from_pydict({"a": x, "b": y, "whole": np.ones(len(x), bool)})


def pairs_within(rows: DataFrame, key: str, id: str) -> DataFrame:
    """Distinct pairs a < b of ids that share a key, for any types of key and id. ``rows``: distinct (key, id).

    A group of m ids is cut into m / ``BLOCK`` blocks (one, for most), and each
    pair of blocks is a join of its own: no task meets more than two blocks of a group.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_splits"))
    known = rows.join(sizes, key)
    own = F.pmod(F.xxhash64(id), F.col("_splits")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))
    left = known.select(key, F.col(id).alias("a"), own.alias("_x"), every.alias("_y"))
    right = known.select(key, F.col(id).alias("b"), every.alias("_x"), own.alias("_y"))
    return left.join(right, [key, "_x", "_y"]).filter("a < b").select("a", "b")


def pairs_sharing_key(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of ids that share a key. ``rows``: key long, id long."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = rows.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_pairs, "a long, b long, whole boolean")
    once = cut_lineage(streamed.distinct())
    rest = once.filter("not whole").select(F.col("b").alias("key"), F.col("a").alias("id"))
    return once.filter("whole").select("a", "b").unionByName(pairs_within(rest, "key", "id")).distinct()
