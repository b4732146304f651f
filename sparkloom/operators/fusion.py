"""Rank fusion: channels of ranked rows become one, with context boosts and a total order.

A channel is a table (query_id, id, rank) or, for one query, (id, rank); its weight
over (k + rank) adds to the id's score.  Channels are stacked and aggregated once,
which needs a single shuffle where full outer joins would need one for each channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
CODE_WEIGHTS = {"graph": 0.9, "vector": 0.05, "bm25": 0.05}
ISSUE_WEIGHTS = {"graph": 0.3, "vector": 0.5, "bm25": 0.2}
CONTEXT_BOOST = 0.003


def ranked(scored: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """A channel's rank column, from 1."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def fuse(channels: dict[str, DataFrame], weights: dict[str, float], key: str, k: int = K, by: list[str] | None = None) -> DataFrame:
    """by..., key, score, channel_ranks (a map from channel to rank)."""
    by = by or []
    rows = None
    for name, df in channels.items():
        part = df.select(*by, key, F.lit(name).alias("channel"), F.col("rank").cast("int").alias("rank"), F.lit(float(weights[name])).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    g = rows.groupBy(*by, key).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"))
    return g


def boost(fused: DataFrame, match: Column, amount: float = CONTEXT_BOOST) -> DataFrame:
    """Adds to the score by context match (0 to 1), and notes it as a channel."""
    return fused.withColumn("_m", match).select(
        *[c for c in fused.columns if c not in ("score", "channel_ranks")],
        (F.col("score") + amount * F.col("_m")).alias("score"),
        F.when(F.col("_m") > 0, F.map_concat("channel_ranks", F.create_map(F.lit("context"), F.lit(1)))).otherwise(F.col("channel_ranks")).alias("channel_ranks"),
        F.col("_m").alias("context_match"),
    )


def stable_order(score: str = "score", path: str = "file_path", line: str = "line_number", symbol: str = "symbol_name", key: str = "id", digits: int = 9) -> list[Column]:
    """Score, best first and rounded, then path, line, symbol and the key's hash: a total order that no engine's float sums disturb."""
    return [F.round(F.col(score), digits).desc(), F.coalesce(F.col(path), F.lit("")), F.coalesce(F.col(line), F.lit(0)), F.coalesce(F.col(symbol), F.lit("")), F.sha1(F.col(key).cast("string"))]


def context_match(language: Column | None, path: Column, wanted_language: tuple[str, ...] = (), repo: str | None = None, tokens: list[str] | None = None) -> Column:
    """0.6 for the language, 0.2 for the repository's name in the path, up to 0.2 for the context's words in it; at most 1."""
    score = F.lit(0.0)
    if wanted_language and language is not None:
        score = score + F.when(F.lower(language).isin(*wanted_language), 0.6).otherwise(0.0)
    if repo:
        score = score + F.when(F.contains(F.lower(path), F.lit(repo.lower())), 0.2).otherwise(0.0)
    if tokens:
        have = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(path), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 2))
        wanted = F.array(*[F.lit(t) for t in sorted(set(tokens))])
        score = score + F.least(F.lit(0.2), 0.2 * F.size(F.array_intersect(have, wanted)) / len(set(tokens)))
    return F.least(score, F.lit(1.0))


def explain(fused: DataFrame, weights: dict[str, float], order: list[Column], k: int = K) -> DataFrame:
    """Each row's final rank and what each channel added to its score."""
    parts = F.transform_values("channel_ranks", lambda c, r: F.element_at(F.create_map(*[F.lit(x) for kv in {**weights, "context": 0.0}.items() for x in kv]), c) / (k + r))
    return fused.withColumn("contributions", parts).withColumn("final_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
