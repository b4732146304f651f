"""Keyed tables: merge, delete, incremental work lists, caches, and the index on disk.

Tables are plain Parquet in parts by file, so a merge writes the parts that it touches (the
rows that stay and the new ones) and takes over the others; a reader of the old version is
never disturbed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.text import language_of_path

IGNORED = set(".git .hg .idea .mypy_cache .pytest_cache .svn .tox .venv __pycache__ build dist node_modules venv".split())
SUFFIXES = "css go htm html java js jsx py rs ts tsx".split()


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Source files below a folder (path, content, language): known suffixes, without ignored folders.  Bytes that aren't UTF-8 are replaced."""
    either = lambda s: "".join(f"[{c}{c.upper()}]" for c in s)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(map(either, SUFFIXES)) + "}").load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)  # noqa: SLF001
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()  # noqa: SLF001
    inside = F.substring("path", len(whole.rstrip("/")) + 2, 1 << 20)
    rel = files.select(inside.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return rel.filter(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(IGNORED)]))).withColumn("language", language_of_path("path"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``new``, and what of ``old`` has no key in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_write(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def delete(old: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return old.join(keys.select(on).distinct(), on, "left_anti")


def stale(old: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Keys that are gone."""
    return old.select(key).distinct().join(now.select(key), key, "left_anti")


def changed(old: DataFrame, now: DataFrame, key: str = "path", value: str = "content") -> DataFrame:
    """key, change: added, modified or deleted, by SHA-256 of the content."""
    a = old.select(key, F.sha2(value, 256).alias("_a"))
    b = now.select(key, F.sha2(value, 256).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).filter("change IS NOT NULL")


def embedding_work(chunks: DataFrame, docs: DataFrame, cache: DataFrame, dtype: str = "float32") -> DataFrame:
    """chunk_id, needs_code, needs_doc: where the cached hashes of content and search document, or the vector type, differ."""
    c = chunks.select(F.col("id").alias("chunk_id"), "content")
    d = docs.select("chunk_id", "search_text")
    full = c.join(d, "chunk_id", "left").join(cache.select("chunk_id", "content_hash", "search_doc_hash", "vector_dtype"), "chunk_id", "left")
    same = F.col("vector_dtype").eqNullSafe(F.lit(dtype))
    code = ~(same & F.sha2("content", 256).eqNullSafe(F.col("content_hash")))
    doc = ~(same & F.sha2(F.coalesce("search_text", "content"), 256).eqNullSafe(F.col("search_doc_hash")))
    return full.select("chunk_id", code.alias("needs_code"), doc.alias("needs_doc")).filter("needs_code OR needs_doc")


EMBEDDING_CACHE = "chunk_id string, content_hash string, search_doc_hash string, vector_dtype string, updated_at timestamp"


def mark_cache(cache: DataFrame, chunks: DataFrame, docs: DataFrame, dtype: str = "float32") -> DataFrame:
    """The cache with these chunks' hashes as current."""
    rows = chunks.select(F.col("id").alias("chunk_id"), "content").join(docs.select("chunk_id", "search_text"), "chunk_id", "left")
    new = rows.select("chunk_id", F.sha2("content", 256).alias("content_hash"), F.sha2(F.coalesce("search_text", "content"), 256).alias("search_doc_hash"), F.lit(dtype).alias("vector_dtype"), F.current_timestamp().alias("updated_at"))
    return upsert(cache, new, ["chunk_id"])


def embedding_status(chunks: DataFrame, docs: DataFrame, cache: DataFrame, code_vectors: DataFrame, doc_vectors: DataFrame, dtype: str = "float32") -> DataFrame:
    """chunk_id, code_current, doc_current: the cached hash is the content's, and the vector is there."""
    work = embedding_work(chunks, docs, cache, dtype)
    held = lambda v, name: v.filter("embedding IS NOT NULL").select("chunk_id").distinct().withColumn(name, F.lit(True))
    out = chunks.select(F.col("id").alias("chunk_id")).join(work, "chunk_id", "left").join(held(code_vectors, "_c"), "chunk_id", "left").join(held(doc_vectors, "_d"), "chunk_id", "left")
    there = lambda need, vector: ~F.coalesce(F.col(need), F.lit(False)) & F.col(vector).isNotNull()
    return out.select("chunk_id", there("needs_code", "_c").alias("code_current"), there("needs_doc", "_d").alias("doc_current"))


def check_vector_type(vectors: DataFrame, dtype: str) -> None:
    """Raises where a table's vectors are of another type than is asked for."""
    kind = {"array<float>": "float32", "array<double>": "float32", "array<tinyint>": "int8"}.get(dict(vectors.dtypes)["embedding"])
    if kind != dtype:
        raise ValueError(f"the index holds {kind} vectors, not {dtype}; build it anew")


# -- a cache of results ----------------------------------------------------------------

#: Levels and their time to live in seconds; 0: for ever.
LEVELS = {1: 0, 2: 86_400, 3: 300}
CACHE = "key string, level int, value string, created_at double, expires_at double, file_hash string, version int"


def cache_put(cache: DataFrame, rows: DataFrame, now: float, ttl: int = 0) -> DataFrame:
    """``rows``: key, level, value, file_hash.  Replaces entries of the same key."""
    life = F.when(F.lit(ttl) > 0, F.lit(float(ttl))).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("level")).cast("double"))
    new = rows.select("key", "level", "value", F.lit(now).alias("created_at"), F.when(life > 0, now + life).otherwise(0.0).alias("expires_at"), "file_hash", F.lit(1).alias("version"))
    return upsert(cache, new, ["key"])


def cache_live(cache: DataFrame, now: float) -> DataFrame:
    return cache.filter((F.col("expires_at") == 0) | (F.col("expires_at") > now))


def cache_invalidate(cache: DataFrame, file_hashes: list[str]) -> DataFrame:
    """Entries of level 2 and up that were made from these files go."""
    return cache.filter((F.col("level") < 2) | ~F.coalesce(F.col("file_hash"), F.lit("")).isin(*file_hashes)) if file_hashes else cache


def cache_delete(cache: DataFrame, key: str) -> DataFrame:
    return cache.filter(F.col("key") != key)


def cache_clear(cache: DataFrame, level: int | None = None) -> DataFrame:
    """Without one level's entries, or empty."""
    return cache.filter(F.col("level") != level) if level is not None else cache.limit(0)


def cache_get(cache: DataFrame, key: str, now: float) -> DataFrame:
    return cache_live(cache, now).filter(F.col("key") == key).select("value")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("level").agg(F.count(F.lit(1)).alias("entries"))


# -- the index ---------------------------------------------------------------------------

TABLES = "chunks symbols calls search_docs code_vectors doc_vectors embedding_cache".split()


#: Parts of each table, by a hash of the file that a row is of.
BUCKETS = 16


def bucket(path: Column) -> Column:
    """The part that a file's rows are in; a chunk's id begins with its file's path and ``#``."""
    return F.pmod(F.hash(F.substring_index(path, "#", 1)), F.lit(BUCKETS))


def _bucket_of(name: str) -> Column | None:
    paths = {"files": "path", "chunks": "file_path", "symbols": "file_path"}
    if name == "calls":
        return bucket(F.regexp_replace("call_site", r":\d+$", ""))
    if name in TABLES or name == "files":
        return bucket(F.col(paths.get(name, "chunk_id")))
    return None


class Index:
    """Versioned Parquet tables below one folder.  A version is a list of parts: those that it wrote, and those that it took over from the version before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001

    def _names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._p(name))] if self._fs.exists(self._p(name)) else []

    def version(self) -> int:
        found = [int(n[1:]) for n in self._names("") if n[1:].isdigit()]
        return max((v for v in found if self._fs.exists(self._p(f"v{v}/_DONE"))), default=0)

    def _parts(self, version: int) -> dict[str, dict]:
        """Of each table: its schema, and its parts' folders by number."""
        if not version:
            return {}
        stream = self._fs.open(self._p(f"v{version}/_DONE"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # noqa: SLF001
        finally:
            stream.close()

    def write(self, tables: dict[str, DataFrame], touched: list[int] | None = None) -> int:
        """A new version; it counts once all its tables are there.  With ``touched``, only those parts are written, and all else is taken over."""
        v = self.version() + 1
        old = self._parts(v - 1)
        new = {n: t for n, t in old.items() if n not in tables} if touched is not None else {}
        for name, df in tables.items():
            by, place = _bucket_of(name), f"v{v}/{name}"
            held = {}
            if by is None:
                df.write.mode("overwrite").parquet(f"{self.path}/{place}")
                held["all"] = place
            else:
                rows = df.withColumn("_bucket", by).hint("rebalance", "_bucket")
                rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{place}")
                held = {n.partition("=")[2]: f"{place}/{n}" for n in self._names(place) if n.startswith("_bucket=")}
                if touched is not None:
                    held |= {b: part for b, part in old.get(name, {"parts": {}})["parts"].items() if int(b) not in touched}
            new[name] = {"schema": df.schema.json(), "parts": held}
        out = self._fs.create(self._p(f"v{v}/_DONE"))
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self._sweep(v, {p for t in (*new.values(), *old.values()) for p in t["parts"].values()})
        return v

    def _sweep(self, v: int, used: set[str]) -> None:
        """What neither this version nor the one before names goes."""
        for n in (n for n in self._names("") if n[1:].isdigit() and int(n[1:]) < v - 1):
            for t in self._names(n):
                parts = [f"{n}/{t}/{b}" for b in self._names(f"{n}/{t}") if b.startswith("_bucket=")] or [f"{n}/{t}"]
                for part in parts:
                    if part not in used:
                        self._fs.delete(self._p(part), True)
            if not any(u.startswith(n + "/") for u in used):
                self._fs.delete(self._p(n), True)

    def read(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """A table, or those of its parts."""
        found = self._parts(self.version())[name]
        schema = StructType.fromJson(json.loads(found["schema"]))
        paths = [f"{self.path}/{p}" for b, p in sorted(found["parts"].items()) if touched is None or int(b) in touched]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stats(self) -> dict[str, int]:
        have = self._parts(self.version())
        return {n: self.read(n).count() for n in TABLES if n in have}

    def snapshot_id(self) -> str:
        import hashlib

        return hashlib.sha1(f"{self.path}|{self.version()}".encode()).hexdigest()[:16]
