"""Exact deduplication with a heavy-hitter split.

Texts are reduced to (doc_id, row number, SHA-256) in one pass; everything after
it moves 40 bytes a document.  A Misra-Gries summary of ``heavy_slots`` counters a
partition finds every digest that may hold more than 1/(heavy_slots+1) of all
rows.  A second pass verifies those digests (their exact count and the row that
stays); this table of at most ``heavy_slots`` rows is broadcast, so the copies of a
hot text are settled on the map side.  All other digests meet in an ordinary
shuffle, pre-aggregated.

Nulls: a null text is an empty text; a null doc_id is smaller than any other.
Rows that repeat both doc_id and text: exactly one of them stays.  Empty tables
give empty results.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Scratch, local_table, numbered, table, tidy

HEAVY_SLOTS = 2048


def merge_counts(summary: dict[bytes, int], new: dict[bytes, int], slots: int) -> dict[bytes, int]:
    """The sum of two Misra-Gries summaries, cut back to ``slots`` counters."""
    for k, v in new.items():
        summary[k] = summary.get(k, 0) + v
    if len(summary) > slots:
        cut = sorted(summary.values(), reverse=True)[slots]
        summary = {k: v - cut for k, v in summary.items() if v > cut}
    return summary


def misra_gries(df: DataFrame, column: str, slots: int) -> list[tuple[bytes, int]]:
    """Candidates for values that hold more than 1/(slots+1) of the rows: at most ``slots``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            seen = b.column(0).value_counts()
            held = merge_counts(held, dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist())), slots)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["value", "n"])

    top = df.select(column).mapInArrow(tidy(count), "value binary, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(slots + 1).collect()
    cut = top[slots]["n"] if len(top) > slots else 0
    return [(bytes(r["value"]), r["n"]) for r in top if r["n"] > cut]


def _settle(spark: SparkSession, rows: DataFrame, slots: int) -> DataFrame:
    """rows: doc_id, uid, digest.  Adds keep_id, keep_uid and group_size."""
    best = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", (-F.col("uid")).alias("back"))).alias("best")]
    heavy = [(v,) for v, n in misra_gries(rows, "digest", slots) if n > 1]
    shape = "digest binary"
    found = rows.join(F.broadcast(local_table(spark, heavy, shape)), "digest").groupBy("digest").agg(*best).collect() if heavy else []
    won = F.broadcast(local_table(spark, [(r["digest"], r["group_size"], r["best"].asDict()) for r in found], "digest binary, group_size long, best struct<doc_id: long, back: long>"))
    rest = rows.join(won.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*best)
    both = rows.join(won, "digest").select("doc_id", "uid", "digest", "group_size", "best").unionByName(rest.join(groups, "digest").select("doc_id", "uid", "digest", "group_size", "best"))
    return both.select("doc_id", "uid", "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_uid"), "group_size")


def digests(docs: DataFrame, key: str = "doc_id", text: Column | str = "text", normalise: Column | None = None) -> DataFrame:
    """doc_id, uid and digest of numbered rows."""
    value = normalise if normalise is not None else F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("_sl_uid").alias("uid"), F.unhex(F.sha2(value, 256)).alias("digest"))


def exact_groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Column | None = None, heavy_slots: int = HEAVY_SLOTS) -> DataFrame:
    """One row per document: doc_id, uid, digest, keep_id, keep_uid, group_size.  ``normalise`` is the text as compared (default: unchanged)."""
    return _groups(spark, numbered(docs), key, text, normalise, heavy_slots)


def _groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Column | None = None, heavy_slots: int = HEAVY_SLOTS) -> DataFrame:
    rows = Scratch(spark, "exact").keep(digests(docs, key, text, normalise), "digests")
    return _settle(spark, rows, heavy_slots)


def exact_dedup(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = numbered(docs)
    kept = _groups(spark, docs, **options).filter("uid = keep_uid").select(F.col("uid").alias("_sl_uid"))
    return docs.join(kept, "_sl_uid", "left_semi").drop("_sl_uid")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_groups(spark, table(spark, sf_dir, "documents"))
    return g.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
