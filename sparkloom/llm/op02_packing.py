"""Conflict-constrained best-fit-decreasing packing.

Documents (sizes in words ``[^\\x20\\x09-\\x0D]+``) go into bins of ``capacity`` words.
A document longer than a bin is cut into full bins and a rest.  Two conflicts hold:
no bin has two documents of one duplicate cluster, nor more than ``per_source`` of one
source.  Each bin carries bitmaps of its clusters and (one for each place) of its
sources.  Open bins are ordered by residual; the search starts at the tightest
residual that the item fits, and goes on from successor to successor until a bin has
no conflict, so the tightest compatible bin is always the one that is taken.

Items are spread over packing groups of about ``group_items`` by a hash of document
and copy, so each task packs a bounded number of items and a hot source or cluster
lies in all groups alike.  Bins of different groups never meet; every group leaves at
most a few part-filled bins.  Only (doc_id, size, source, cluster) is shuffled.
Rows of equal doc_id, source, cluster and size are counted before that, and told apart
by a copy number.

Nulls: a null or blank text has size 0 and no bin (bin_id null); a null source is a
source like others; a null cluster, or the empty text's, conflicts with none.  Rows
that repeat a doc_id are separate items, and bins are numbered within their group, so no
two bins share a number.  Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import count_words, pieces
from .work import Scratch, table, tidy

CAPACITY, PER_SOURCE, GROUP_ITEMS = 2048, 2, 8192


def best_fit(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[int]:
    """A bin number for each (size, source, cluster), in the given order.  Sizes are from 1 to the capacity."""
    cluster_count = Counter(c for _, _, c in items if c is not None)
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in cluster_count.items() if n > 1)}
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for _, s, _ in items))}
    by_residual: dict[int, list[int]] = {}
    residuals = 0  # bit r: there are bins with residual r
    clusters: list[int] = []
    sources: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        c, s = cluster_bit.get(cluster, 0), source_bit[source]
        chosen, r, left = -1, 0, residuals >> size
        r = size
        while left:
            step = (left & -left).bit_length() - 1
            r += step
            for k, b in enumerate(by_residual[r]):
                if not clusters[b] & c and not sources[b][-1] & s:
                    chosen = b
                    del by_residual[r][k]
                    break
            if chosen >= 0:
                break
            left >>= step + 1
            r += 1
        if chosen < 0:
            chosen, r = len(clusters), capacity
            clusters.append(0)
            sources.append([0] * per_source)
        elif not by_residual[r]:
            del by_residual[r]
            residuals &= ~(1 << r)
        clusters[chosen] |= c
        planes = sources[chosen]
        for k in range(per_source):
            if not planes[k] & s:
                planes[k] |= s
                break
        if r > size:
            by_residual.setdefault(r - size, []).append(chosen)
            residuals |= 1 << (r - size)
        out.append(chosen)
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for a, b, data, off in pieces(batch.column(3)):
            n[a:b] = count_words(data, off)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], ["doc_id", "source", "cluster", "size"])


def _pack(capacity: int, per_source: int):
    names = ["doc_id", "copy", "piece", "size", "source", "cluster", "bin_id"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def done(group: int | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (doc_id, copy, full bins, size of the rest, source, cluster)."""
        if group is None:
            return
        packed = [r for r in rows if r[3]]
        bins = best_fit([(r[3], r[4], r[5]) for r in packed], capacity, per_source)
        if packed:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*packed), kinds)), pa.array([(group << 32) | b for b in bins], pa.int64())], names)
        at = (group << 32) | max(bins, default=-1) + 1
        for doc, copy, whole, _, source, cluster in rows:  # full bins need no search
            for lo in range(0, whole, 65536):
                n = min(65536, whole - lo)
                same = [pa.array([v] * n, k) for v, k in zip((doc, copy, capacity, source, cluster), (kinds[0], kinds[1], kinds[3], kinds[4], kinds[5]))]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(np.arange(lo, lo + n)), *same[2:], pa.array(np.arange(at, at + n))], names)
                at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now:
                    yield from done(now, rows)
                    now, rows = group, []
                rows.append(tuple(row))
        yield from done(now, rows)

    return run


def pack(spark: SparkSession, docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per document and bin: doc_id, copy (of equal rows), piece, size, source, cluster, bin_id (null without words).

    ``cluster`` is a column of ``docs`` (cast to long) that names the duplicate cluster; by default documents of equal text are one.
    """
    tmp = Scratch(spark, "packing")
    own = F.when(F.coalesce("text", F.lit("")) != "", F.xxhash64("text")) if cluster is None else cluster.cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("cluster"), "text")
    sized = rows.mapInArrow(tidy(_sizes), "doc_id long, source string, cluster long, size long")
    counted = tmp.keep(sized.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("copies")), "items")
    total = counted.agg(F.sum(F.col("copies") * F.ceil(F.col("size") / capacity))).first()[0] or 0
    groups = max(1, -(-int(total) // group_items))
    items = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rest = items.filter("size > 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "source", "size", "copy"), F.lit(groups)).cast("int"))
    rest = rest.select("group", "doc_id", "copy", (F.col("size") / capacity).cast("long").alias("whole"), (F.col("size") % capacity).alias("size"), "source", "cluster")
    rest = rest.repartition("group").sortWithinPartitions("group", F.desc("size"), "doc_id", "source", "cluster", "copy", "whole")
    packed = rest.mapInArrow(tidy(_pack(capacity, per_source)), "doc_id long, copy long, piece long, size long, source string, cluster long, bin_id long")
    none = items.filter("size = 0").select("doc_id", "copy", F.lit(0).cast("long").alias("piece"), "size", "source", "cluster", F.lit(None).cast("long").alias("bin_id"))
    return packed.unionByName(none)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
