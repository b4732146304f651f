"""Look-ups in the index.  Where several rows answer, the choice is a total order, never the first that comes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.bm25 import bm25


def chunk(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.filter(F.col("id") == key)


def symbol(symbols: DataFrame, qualified_name: str) -> DataFrame:
    return symbols.filter(F.col("qualified_name") == qualified_name)


def chunk_by_symbol(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.filter(F.col("symbol_name") == name).orderBy("file_path", "start_line", "id").limit(1)


def chunk_by_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("file_path") == path).orderBy("start_line", "id").limit(1)


def chunk_ids_by_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("file_path") == path).orderBy("start_line", "id").select("id")


def chunks_by_qualified(names: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each ``name``: the chunk of its symbol in its file and class, else in its file, else of that simple name anywhere, else the file's first chunk.

    Chunks are first reduced to the best of each name, file and class, of each name and file, of
    each name and of each file, so no join gives a row more than one; the least priority wins.
    """
    parts = F.split("name", r"\.")
    places = symbols.select(F.col("qualified_name").alias("name"), "file_path").distinct()
    wanted = names.select("name").distinct().join(places, "name", "left")
    wanted = wanted.select("name", F.col("file_path").alias("_f"), F.element_at(parts, -1).alias("_n"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("_p"))
    c = chunks.select("id", "symbol_name", "parent_symbol", "file_path", "start_line")
    kinds = [["symbol_name", "file_path", "parent_symbol"], ["symbol_name", "file_path"], ["symbol_name"], ["file_path"]]
    asked = {"symbol_name": F.col("_n"), "file_path": F.col("_f"), "parent_symbol": F.col("_p")}
    out = wanted
    for prio, keys in enumerate(kinds):
        order = F.struct(F.lit(prio).alias("prio"), "file_path", "start_line", "id")
        best = c.groupBy(*[F.col(x).alias(f"_k{x}") for x in keys]).agg(F.min(order).alias(f"_b{prio}"))
        on = [F.col(f"_k{x}").eqNullSafe(asked[x]) if x == "parent_symbol" else F.col(f"_k{x}") == asked[x] for x in keys]
        out = out.join(best, on, "left").drop(*[f"_k{x}" for x in keys])
    found = out.select("name", F.coalesce(*[f"_b{prio}" for prio in range(len(kinds))]).alias("b")).filter("b IS NOT NULL")
    return found.groupBy("name").agg(F.min("b").alias("b")).select("name", "b.id", "b.prio")


def symbols_by_name(symbols: DataFrame, name: str, top_k: int = 10) -> DataFrame:
    """BM25 (all terms) over names and signatures, exact names first."""
    found = bm25(symbols, re.sub("[.()]+", " ", name), "qualified_name", ["name", "signature"], keep=["name", "file_path", "symbol_type"])
    last = name.rpartition(".")[2]
    return found.orderBy(F.desc(F.col("name") == last), F.desc("score"), "qualified_name").limit(top_k)


def symbols_fts(symbols: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """BM25 (all terms) over name, qualified name, signature and file: the best ``limit``."""
    return bm25(symbols, re.sub("[.()]+", " ", name), "qualified_name", ["name", "qualified_name", "signature", "file_path"], limit, keep=["name", "file_path", "symbol_type"])


def search_document(docs: DataFrame, chunk_id: str) -> DataFrame:
    return docs.filter(F.col("chunk_id") == chunk_id).select("search_text")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def remove_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Without a file's nodes, and the edges that its own calls made (edges of other files into it stay)."""
    return nodes.filter(F.col("file_path") != path), edges.filter(~F.col("call_site").startswith(path + ":"))
