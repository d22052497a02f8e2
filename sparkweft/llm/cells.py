"""Joins of points that share a grid cell, without a row for each pair.

Rows (cell, role, ...) are dealt to tasks by cell; role 0 is a point in its own cell, role 1 a
point that probes the cell of others. Every point is compared with the own points of its cell,
vectorised over many cells at once. The own points of a crowded cell are dealt into blocks, and
each pair of blocks is a task of its own, so no task holds more than one block and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import durable

#: Pairs compared at once.
CHUNK = 1_000_000
#: Crowded cells that are broadcast, counted before.
BROADCAST_CELLS = 100_000


def spread(rows: DataFrame, point: Column, block: int) -> DataFrame:
    """Adds base_block, query_block, query to rows (cell, role, ...), sorted for ``candidates``.

    Cells of more than ``block`` own points are few: at most one for so many points. Base rows (query false) are
    held by their task, query rows are compared with them.
    """
    crowded = durable(
        rows.where("role = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
        .select(F.col("cell").alias("__cell"), F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    )
    found = crowded.count()
    if not found:
        dealt = rows.withColumn("__blocks", F.lit(1))
    else:
        # two numbers a row; the hint only where the count bounds it
        dealt = rows.join(F.broadcast(crowded) if found <= BROADCAST_CELLS else crowded, F.col("cell") == F.col("__cell"), "left").drop("__cell")
    own = F.pmod(F.xxhash64(point), F.coalesce("__blocks", F.lit(1))).cast("int")
    pair = lambda base, query, asks: F.struct(base.alias("base_block"), query.alias("query_block"), asks.alias("query"))
    blocks = F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1)
    mine = F.col("__own")
    bases = F.when(F.col("role") == 0, F.transform(blocks, lambda x: pair(mine, x, F.lit(False)))).otherwise(F.array().cast("array<struct<base_block:int,query_block:int,query:boolean>>"))
    asking = F.transform(F.filter(blocks, lambda x: (F.col("role") == 1) | (x < mine)), lambda x: pair(x, mine, F.lit(True)))
    dealt = dealt.withColumn("__own", own)
    dealt = dealt.withColumn("__task", F.explode(F.concat(bases, asking))).select("*", "__task.*").drop("__task", "__own", "__blocks")
    return dealt.repartition("cell", "base_block", "query_block").sortWithinPartitions("cell", "base_block", "query_block", "query")


def candidates(batches: Iterator[pa.RecordBatch], columns: dict[str, Callable]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(columns, left, right): chunks of pairs of row numbers to compare, left a base row."""
    held: dict[str, np.ndarray] | None = None
    keys = ("cell", "base_block", "query_block")
    for batch in batches:
        got = {k: np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (*keys, "query", "role")}
        got |= {k: f(batch.column(k)) for k, f in columns.items()}
        n_held = 0
        if held is not None:
            n_held = len(held["cell"])
            got = {k: np.concatenate([held[k], v]) for k, v in got.items()}
        n = len(got["cell"])
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = False
        for k in keys:
            new[1:] |= got[k][1:] != got[k][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        base = ~got["query"].astype(bool)
        group = np.cumsum(new) - 1
        n_base = np.bincount(group, weights=base).astype(np.int64)[group]
        # a base row meets the base rows before it, unless its task pairs two blocks
        alike = got["base_block"] == got["query_block"]
        meets = np.where(base, np.where(alike, np.arange(n) - start, 0), n_base)
        meets[:n_held] = 0
        at, ends = 0, np.cumsum(meets)
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            counts = meets[at:to]
            total = int(counts.sum())
            if total:
                right = np.repeat(np.arange(at, to), counts)
                inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                yield got, start[right] + inside, right
            at = to
        last = np.flatnonzero(base & (start == start[-1]))
        held = {k: v[last] for k, v in got.items()}


def forest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' links, as an edge from each linked row's id to the least id that it reaches."""
    nodes, at = np.unique(np.concatenate([ids[left], ids[right]]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]
