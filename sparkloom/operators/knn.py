"""Exact nearest neighbours of dense vectors.

Queries travel to the scan in blocks of at most ``QUERY_BYTES``.  There a block meets the
vectors in tiles of ``TILE`` scores, of which only those go on that can still be among a
query's best k, so memory depends neither on the number of queries nor on the vectors.
What is shuffled is partitions * queries * k rows.  Several blocks are processed one after
the other over the same scan, each written before the next is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import cut, spread

QUERY_BYTES = 32 << 20
#: Scores in a tile, its queries, and the rows of the first one, which nothing bounds yet.
TILE, TILE_QUERIES, FIRST_ROWS = 1 << 20, 512, 64
METRICS = ("l2", "cosine", "dot")


def _pairs(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def quantise(v: Column) -> Column:
    """A unit vector's components as signed bytes: [-1, 1] to [-128, 127]."""
    return F.transform(v, lambda x: F.least(F.lit(127), F.greatest(F.lit(-128), F.round(x.cast("double") * 127.5 - 0.5).cast("int"))).cast("tinyint"))


def knn_one(vectors: DataFrame, query: list[float], key: str, vector: str, k: int, metric: str = "l2", digits: int = 6) -> DataFrame:
    """The k nearest rows to a literal vector, by built-in functions: key, score (higher is nearer)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector)
    s = -l2(v, q) if metric == "l2" else cosine(v, q) if metric == "cosine" else dot(v, q)
    return vectors.select("*", F.round(s, digits).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _asked(queries: np.ndarray, metric: str) -> np.ndarray:
    """The queries' side of a product that rises with the score."""
    if metric == "cosine":
        with np.errstate(all="ignore"):
            return queries / np.sqrt((queries**2).sum(1))[:, None]
    return np.hstack([queries, np.ones((len(queries), 1))]) if metric == "l2" else queries


def _held(x: np.ndarray, metric: str) -> np.ndarray:
    """The vectors' side.  For L2 a row's product is at least half of the query's square less that of the distance."""
    if metric == "cosine":
        with np.errstate(all="ignore"):
            return x / np.sqrt((x**2).sum(1))[:, None]
    return np.hstack([x, -(1 - _error(x)) / 2 * (x**2).sum(1)[:, None]]) if metric == "l2" else x


def _error(x: np.ndarray) -> float:
    """A bound on a product's error, as a share of its terms' sizes."""
    return 16 * x.shape[1] * np.finfo(float).eps


def _least(worst: np.ndarray, queries: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """What a product must reach if its row is to be no worse than ``worst``; ties after rounding count.

    The expanded square loses digits on nearly equal vectors, so products only rule rows out, by a
    bound on their error; all others are measured pair by pair.
    """
    square = (queries**2).sum(1)
    if metric == "l2":
        least = ((1 - _error(x)) * square - (2e-6 - worst) ** 2) / 2
    else:
        least = worst - 2e-6 - (_error(x) * np.sqrt(square * (x**2).sum(1).max()) if metric == "dot" else 0)
    return np.where(np.isneginf(worst), -np.inf, least)[:, None]


def _scores(queries: np.ndarray, x: np.ndarray, q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Rounded scores of the pairs q, r."""
    out = np.empty(len(q))
    for lo in range(0, len(q), 16384):
        a, b = queries[q[lo : lo + 16384]], x[r[lo : lo + 16384]]
        if metric == "l2":
            s = 0.0 - np.sqrt(((b - a) ** 2).sum(1))
        else:
            s = (a * b).sum(1)
            if metric == "cosine":
                with np.errstate(all="ignore"):
                    s = s / (np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1)))
        out[lo : lo + 16384] = np.round(s, 6)
    return out


def _merge(top_s: np.ndarray, top_i: np.ndarray, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
    """Puts the pairs into the best k of their queries, in place: by score, then id."""
    k = top_s.shape[1]
    hit = np.unique(q)
    q = np.concatenate([q, np.repeat(hit, k)])
    s, i = np.concatenate([s, top_s[hit].ravel()]), np.concatenate([i, top_i[hit].ravel()])
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    top_s[q[keep], place[keep]], top_i[q[keep], place[keep]] = s[keep], i[keep]


def _best(ids: np.ndarray, queries: np.ndarray, k: int, metric: str, key: str, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _asked(queries, metric)
        top_s = np.full((len(ids), k), -np.inf)
        top_i = np.zeros((len(ids), k), np.int64)
        rows = FIRST_ROWS
        for batch in batches:
            keep = batch.filter(batch.column(1).is_valid())
            lo = 0
            while lo < keep.num_rows and len(ids):
                part = keep.slice(lo, rows)
                x, names = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64), part.column(0).to_numpy()
                held = _held(x, metric).T
                for at in range(0, len(ids), TILE_QUERIES):
                    own = slice(at, at + TILE_QUERIES)
                    worst = top_s[own, -1]
                    q, r = np.nonzero(asked[own] @ held >= _least(worst, queries[own], x, metric))
                    s = _scores(queries[own], x, q, r, metric)
                    ok = (s >= worst[q]) & np.isfinite(s)
                    if ok.any():
                        _merge(top_s[own], top_i[own], q[ok], s[ok], names[r[ok]])
                lo, rows = lo + rows, min(2 * rows, TILE // TILE_QUERIES)
        q, at = np.nonzero(np.isfinite(top_s))
        for lo in range(0, len(q), 65536):
            a, b = q[lo : lo + 65536], at[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(top_i[a, b]), pa.array(top_s[a, b])], ["query_id", key, "score"])

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int, metric: str = "l2") -> DataFrame:
    """For each query the k nearest rows: query_id, key, score, rank."""
    if metric not in METRICS:
        raise ValueError(metric)
    shape = f"query_id long, {key} long, score double"
    rows = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vector).alias("v")).filter("v IS NOT NULL")
    first = rows.select(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-first[0] * (8 * (first[1] or 1) + 16 * k) // QUERY_BYTES))
    dealt = spread(vectors.select(F.col(key).cast("long"), vector))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    out = None
    for b in range(blocks):
        got = (rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toArrow()
        ids = got.column(0).to_numpy()
        q = np.stack(got.column(1).to_numpy()).astype(np.float64) if len(ids) else np.zeros((0, 1))
        near = dealt.mapInArrow(_best(ids, q, k, metric, key, vector), shape).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
        near = near if blocks == 1 else cut(near)
        out = near if out is None else out.unionByName(near)
    return out
