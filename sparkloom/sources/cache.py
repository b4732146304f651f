"""A stored cache of results in levels: level 1 lives for ever, level 2 for a day, level 3 for minutes.

Entries are rows of a Parquet table in versions (``store.Index``), so readers are never
disturbed; a write is one merge, so put many entries at once where that is possible.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: What a kind of entry is called in its key, and its level.
KINDS = {"layer": 1, "subgraph": 2, "query": 3}
HASHES = "path string, file_hash string"


def file_hash(path: str, content: str | bytes) -> str:
    """SHA-256 of a file's path and content."""
    import hashlib

    return hashlib.sha256(path.encode() + b"\0" + (content.encode() if isinstance(content, str) else content)).hexdigest()


class Cache:
    """``Cache(spark, path)``; ``clock`` gives the time in seconds."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.clock, self.tables = spark, clock, store.Index(spark, path)
        if not self.tables.version():
            self._write(spark.createDataFrame([], store.CACHE), spark.createDataFrame([], HASHES))

    def _write(self, entries: DataFrame | None = None, hashes: DataFrame | None = None) -> None:
        read = self.tables.read
        self.tables.write({"entries": entries if entries is not None else read("entries"), "hashes": hashes if hashes is not None else read("hashes")})

    def entries(self) -> DataFrame:
        return store.cache_live(self.tables.read("entries"), self.clock())

    def get(self, key: str) -> str | None:
        """The value of a live entry, or None."""
        row = store.cache_get(self.tables.read("entries"), key, self.clock()).first()
        return row["value"] if row else None

    def put(self, rows: DataFrame, ttl: int = 0) -> None:
        """``rows``: key, level, value, file_hash."""
        self._write(store.cache_put(self.tables.read("entries"), rows, self.clock(), ttl))

    def set(self, key: str, value: str, level: int = 3, ttl: int = 0, file_hash: str | None = None) -> None:
        self.put(self.spark.createDataFrame([(key, level, value, file_hash)], "key string, level int, value string, file_hash string"), ttl)

    def delete(self, key: str) -> None:
        self._write(store.cache_delete(self.tables.read("entries"), key))

    # -- kinds of entries -----------------------------------------------------------

    def get_kind(self, kind: str, name: str) -> str | None:
        """A layer's, subgraph's or query's entry."""
        return self.get(f"{kind}:{name}")

    def set_kind(self, kind: str, name: str, value: str, file_hash: str | None = None) -> None:
        self.set(f"{kind}:{name}", value, KINDS[kind], file_hash=file_hash)

    # -- files ------------------------------------------------------------------------

    def changed(self, files: DataFrame) -> DataFrame:
        """Of ``files`` (path, file_hash) those that are new or whose hash differs from the one that is remembered."""
        known = self.tables.read("hashes").select("path", F.col("file_hash").alias("_known"))
        return files.join(known, "path", "left").filter(~F.col("_known").eqNullSafe(F.col("file_hash"))).select("path", "file_hash", "_known")

    def update_files(self, files: DataFrame) -> None:
        """Remember the hashes of ``files`` (path, file_hash); entries of level 2 and up that rest on a hash which is no longer true go."""
        gone = self.changed(files).select(F.col("_known").alias("file_hash")).filter("file_hash IS NOT NULL").distinct()
        kept = self.tables.read("entries").join(gone.withColumn("_gone", F.lit(True)), "file_hash", "left").filter("level < 2 OR _gone IS NULL")
        entries = self.tables.read("entries")
        self._write(kept.select(*entries.columns), store.upsert(self.tables.read("hashes"), files.select("path", "file_hash"), ["path"]))

    def invalidate(self, file_hashes: Iterable[str]) -> None:
        self._write(store.cache_invalidate(self.tables.read("entries"), list(file_hashes)))

    def clear(self, level: int | None = None) -> None:
        self._write(store.cache_clear(self.tables.read("entries"), level))

    def cleanup(self) -> int:
        """Drops what has run out; returns how many entries that were."""
        entries = self.tables.read("entries")
        live = store.cache_live(entries, self.clock())
        n = entries.count() - live.count()
        if n:
            self._write(live)
        return n

    def stats(self) -> dict[int, int]:
        """Entries by level."""
        return {r["level"]: r["entries"] for r in store.cache_stats(self.entries()).collect()}
