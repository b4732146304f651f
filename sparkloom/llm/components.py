"""Connected components of an edge table (a, b long)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Scratch, tidy

#: Edge lists up to this many rows (16 bytes each) are solved in one task; longer ones by the distributed star algorithm.  Both give the same labels.
ONE_TASK = 2_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    lab = np.arange(len(nodes))
    while len(x):
        low = np.minimum(lab[x], lab[y])
        np.minimum.at(lab, lab[x], low)
        np.minimum.at(lab, lab[y], low)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
        differ = lab[x] != lab[y]
        x, y = x[differ], y[differ]
    return nodes, nodes[lab]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        node, root = labels(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        for k in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 100_000]), pa.array(root[k : k + 100_000])], ["node", "root"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step.  Minima are pre-aggregated; no neighbourhood is collected."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return kept.filter("a <> b").distinct()


def components(scratch: Scratch, edges: DataFrame, name: str, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component."""
    edges = scratch.keep(edges.toDF("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    if edges.count() <= one_task:
        return edges.repartition(1).mapInArrow(tidy(_one_task), "node long, root long")
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)]
    before, turn = None, 0
    while True:
        edges = scratch.keep(_star(_star(edges, True), False), f"{name}-{turn}")
        now = tuple(edges.agg(*print_of).first())
        if turn:
            scratch.drop(f"{name}-{turn - 1}")
        if now == before:
            break
        before, turn = now, turn + 1
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
