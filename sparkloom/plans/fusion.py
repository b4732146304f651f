"""Fusion of lexical, vector and graph ranks.  Ids of documents and embeddings are paired by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import language_family
from sparkloom.operators import fusion as R
from sparkloom.operators.bm25 import bm25
from sparkloom.operators.knn import knn_one
from sparkloom.sources.tables import table

from .base import query
from .lexical import WORDS, bm25_sql
from .vectors import _sql, _vectors

N = 30
_BM25 = bm25_sql(WORDS, "documents", "doc_id", ["text"], "doc_id", N, True)
_CHANNELS = f"""
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_BM25})),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_sql('l2', N)})),
g AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, len(string_split(text, 'tion')) - 1 AS n FROM documents ORDER BY n DESC, doc_id LIMIT {N}))"""


def channels(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    e, q = _vectors(spark, d)
    score = [F.desc("score"), F.col("id")]
    b = bm25(docs, WORDS, "doc_id", ["text"], N, True).select(F.col("doc_id").alias("id"), "score")
    v = knn_one(e, q, "vec_id", "embedding", N).select(F.col("vec_id").alias("id"), "score")
    g = docs.select(F.col("doc_id").alias("id"), (F.size(F.split("text", "tion", -1)) - 1).alias("score")).orderBy(*score).limit(N)
    return {"bm25": R.ranked(b, score), "vector": R.ranked(v, score), "graph": R.ranked(g, score)}


def _fused(weights: dict[str, float], names: list[str]) -> str:
    short = {"bm25": "b", "vector": "v", "graph": "g"}
    rows = " UNION ALL ".join(f"SELECT id, '{n}' AS channel, rank, {weights[n]}::DOUBLE AS w FROM {short[n]}" for n in names)
    return f"WITH {_CHANNELS}, f AS (SELECT id, sum(w / (60 + rank)) AS score, string_agg(channel || '=' || rank, ',' ORDER BY channel) AS channels FROM ({rows}) GROUP BY id)"


def _flat() -> Column:
    return F.concat_ws(",", F.transform(F.map_entries("channel_ranks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))


def _three(weights: dict[str, float]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = R.fuse(channels(spark, d), weights, "id").select("id", F.round("score", 9).alias("score"), _flat().alias("channels"))
        return out.orderBy(F.desc("score"), F.sha1(F.col("id").cast("string"))).limit(20)

    return run


for _name, _w in (("rrf_3way", R.CODE_WEIGHTS), ("rrf_3way_issue", R.ISSUE_WEIGHTS)):
    query(_name, _fused(_w, ["bm25", "vector", "graph"]) + " SELECT id, round(score, 9) AS score, channels FROM f ORDER BY round(score, 9) DESC, sha1(id::VARCHAR) LIMIT 20")(_three(_w))


@query("rrf_2way", _fused(R.CODE_WEIGHTS, ["bm25", "vector"]) + " SELECT id, round(score, 9) AS score FROM f ORDER BY round(score, 9) DESC, sha1(id::VARCHAR) LIMIT 20")
def rrf_2way(spark: SparkSession, d: str) -> DataFrame:
    """Weights aren't scaled up for the missing channel."""
    c = channels(spark, d)
    out = R.fuse({k: c[k] for k in ("bm25", "vector")}, R.CODE_WEIGHTS, "id").select("id", F.round("score", 9).alias("score"))
    return out.orderBy(F.desc("score"), F.sha1(F.col("id").cast("string"))).limit(20)


_MATCH = "least(1.0, CASE WHEN lower(d.lang) IN ('de') THEN 0.6 ELSE 0.0 END + CASE WHEN contains(lower(d.source), 'src1') THEN 0.2 ELSE 0.0 END + least(0.2, 0.2 * len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(d.source), '[a-z0-9]+')), lambda t: length(t) >= 2), ['src15', 'src3'])) / 2))"


@query(
    "rrf_context_boost",
    _fused(R.CODE_WEIGHTS, ["bm25", "vector", "graph"]) + f"""
SELECT id, round(score + 0.003 * m, 9) AS score, round(m, 6)::DOUBLE AS context_match FROM (SELECT f.id, f.score, coalesce({_MATCH}, 0.0)::DOUBLE AS m FROM f LEFT JOIN documents d ON d.doc_id = f.id)
ORDER BY round(score + 0.003 * m, 9) DESC, sha1(id::VARCHAR) LIMIT 20""",
)
def rrf_context_boost(spark: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(channels(spark, d), R.CODE_WEIGHTS, "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    match = F.coalesce(R.context_match(F.col("lang"), F.col("source"), language_family("de"), "src1", ["src3", "src15"]), F.lit(0.0))
    out = R.boost(fused.join(docs, "id", "left"), match).select("id", F.round("score", 9).alias("score"), F.round("context_match", 6).alias("context_match"))
    return out.orderBy(F.desc("score"), F.sha1(F.col("id").cast("string"))).limit(20)


@query("context_match", f"SELECT doc_id, round({_MATCH}, 6)::DOUBLE AS context_match FROM documents d")
def context_match(spark: SparkSession, d: str) -> DataFrame:
    m = R.context_match(F.col("lang"), F.col("source"), language_family("de"), "src1", ["src3", "src15"])
    return table(spark, d, "documents").select("doc_id", F.round(m, 6).alias("context_match"))


@query(
    "rrf_explain",
    _fused(R.CODE_WEIGHTS, ["bm25", "vector", "graph"]) + """, r AS (SELECT id, score, channels, row_number() OVER (ORDER BY round(score, 9) DESC, sha1(id::VARCHAR)) AS final_rank FROM f)
SELECT r.id, r.final_rank, u.channel, round(u.w / (60 + u.rank), 9) AS contribution FROM r JOIN (SELECT id, 'bm25' AS channel, rank, 0.05::DOUBLE AS w FROM b UNION ALL SELECT id, 'vector', rank, 0.05 FROM v UNION ALL SELECT id, 'graph', rank, 0.9 FROM g) u USING (id) WHERE final_rank <= 10""",
)
def rrf_explain(spark: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(channels(spark, d), R.CODE_WEIGHTS, "id")
    out = R.explain(fused, R.CODE_WEIGHTS, [F.round("score", 9).desc(), F.sha1(F.col("id").cast("string"))]).filter("final_rank <= 10")
    return out.select("id", "final_rank", F.explode("contributions").alias("channel", "c")).select("id", "final_rank", "channel", F.round("c", 9).alias("contribution"))


@query("stable_topk", "SELECT doc_id, source, n_chars FROM documents ORDER BY round(n_chars / 100, 0) DESC, source, sha1(doc_id::VARCHAR) LIMIT 40")
def stable_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", (F.col("n_chars") / 100).alias("score"), F.lit(0).alias("line"), F.lit("").alias("symbol"))
    return rows.orderBy(*R.stable_order("score", "source", "line", "symbol", "doc_id", 0)).limit(40).select("doc_id", "source", "n_chars")


