"""Vector search over embeddings.  The query vector is that of vec_id 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.knn import knn_batch, knn_one, quantise
from sparkloom.sources.tables import table

from .base import query

PROBE = 7
_V, _Q = "e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]"
_DIST = {"l2": f"0 - list_distance({_V}, {_Q})", "cosine": f"list_cosine_similarity({_V}, {_Q})", "dot": f"list_dot_product({_V}, {_Q})"}


def _sql(metric: str, k: int = 10, where: str = "true") -> str:
    return f"SELECT e.vec_id, e.label, round({_DIST[metric]}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q WHERE {where} ORDER BY score DESC, e.vec_id LIMIT {k}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, d, "embeddings")
    return e, list(e.filter(F.col("vec_id") == PROBE).select("embedding").first()[0])


def _nearest(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e, q = _vectors(spark, d)
        return knn_one(e, q, "vec_id", "embedding", 10, metric).select("vec_id", "label", "score")

    return run


for _metric in _DIST:
    query(f"knn_{_metric}", _sql(_metric))(_nearest(_metric))


@query("knn_prefilter", _sql("l2", where="e.label = 1"))
def knn_prefilter(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return knn_one(e.filter("label = 1"), q, "vec_id", "embedding", 10).select("vec_id", "label", "score")


@query("knn_postfilter", f"SELECT * FROM ({_sql('l2', 30)}) WHERE label = 1")
def knn_postfilter(spark: SparkSession, d: str) -> DataFrame:
    """The filter sees only the k nearest, so fewer rows may come."""
    e, q = _vectors(spark, d)
    return knn_one(e, q, "vec_id", "embedding", 30).filter("label = 1").select("vec_id", "label", "score")


_QUANT = "list_transform({0}::DOUBLE[], lambda x: least(127, greatest(-128, round(x * 127.5 - 0.5)::INT)))"


@query("knn_int8", f"SELECT e.vec_id, round(0 - list_distance({_QUANT.format('e.embedding')}::DOUBLE[], {_QUANT.format('q.embedding')}::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q ORDER BY score DESC, e.vec_id LIMIT 10")
def knn_int8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("small", quantise(F.col("embedding")))
    q = list(e.filter(F.col("vec_id") == PROBE).select("small").first()[0])
    return knn_one(e, q, "vec_id", "small", 10).select("vec_id", "score")


_NEAR = """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label AS el, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
           FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
"""


@query("knn_batch", _NEAR + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return knn_batch(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 10, "cosine").select("query_id", "vec_id", "score", "rank")


@query(
    "knn_batch_l2",
    """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(0 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 3 = 0)) WHERE rank <= 5""",
)
def batch_l2(spark: SparkSession, d: str) -> DataFrame:
    """More queries than any small block holds."""
    e = table(spark, d, "embeddings")
    return knn_batch(e, e.filter("vec_id % 3 = 0"), "vec_id", "embedding", "vec_id", "embedding", 5, "l2").select("query_id", "vec_id", "score", "rank")


@query(
    "knn_label_precision",
    _NEAR + """, s AS (SELECT query_id, avg((ql = el)::INT)::DOUBLE AS p, coalesce(max(CASE WHEN ql = el THEN 1.0 / rank END), 0)::DOUBLE AS rr FROM r WHERE vec_id <> query_id AND rank <= 11 GROUP BY query_id)
SELECT count(*)::BIGINT AS queries, round(avg(p), 6) AS precision_at_10, round(avg(rr), 6) AS mrr FROM s""",
)
def knn_label_precision(spark: SparkSession, d: str) -> DataFrame:
    """How often neighbours share the query's label, and the mean reciprocal rank of the first that does."""
    e = table(spark, d, "embeddings")
    near = knn_batch(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 11, "cosine").filter("vec_id <> query_id")
    labels = e.select("vec_id", "label")
    both = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    hit = F.col("label") == F.col("ql")
    per = both.groupBy("query_id").agg(F.avg(hit.cast("int")).alias("p"), F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("p"), 6).alias("precision_at_10"), F.round(F.avg("rr"), 6).alias("mrr"))
