"""Written intermediate tables, and other plumbing that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def setting(spark: SparkSession, name: str) -> str | None:
    return spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Only where it is unset, as in tests, a local one is made and set."""
    found = setting(spark, "spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        _local.append(found[7:])
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows (structs as dicts), sent as Arrow data: plain rows run a Python job of another kind, whose daemon and workers then stay in every executor."""
    shape = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(shape.names, r)) for r in rows], to_arrow_schema(shape)), shape)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with free memory given back before and after: a worker lives on, and would keep what its largest task took."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return tidied


class Scratch:
    """Tables written under the shared folder to cut lineage; they go when ``drop`` is called, or at the end of the process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a table and read it back: lost executors then only reread files."""
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # at exit the JVM may be gone already
            if self.path.startswith("file://"):
                shutil.rmtree(os.path.join(self.path[7:], name), ignore_errors=True)


#: Bits of a row's place in its file, and of the number of that file.
ROW_BITS, FILE_BITS = 26, 37
_PLAIN = ("plans.logical.Project", "plans.logical.Filter", "plans.logical.SubqueryAlias", "datasources.LogicalRelation")
_SCHEME = "^[A-Za-z0-9+.-]+:/*"


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, in every job that reads ``docs``."""
    todo, relations = [docs._jdf.queryExecution().analyzed()], 0  # noqa: SLF001
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        if not name.endswith(_PLAIN) or not node.deterministic():
            return False
        relations += name.endswith("LogicalRelation")
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return relations == 1


def file_modulus(paths: list[str], bits: int = FILE_BITS) -> int:
    """An odd number below 2**bits that leaves each path's hash another remainder."""
    held = np.array([xxhash.xxh64_intdigest(re.sub(_SCHEME, "", p).encode(), 42) for p in set(paths)], np.uint64).view(np.int64)
    for m in range((1 << bits) - 1, 1 << (bits - 1), -2):
        if len(np.unique(np.mod(held, m))) == len(held):
            return m
    raise ValueError("too many files")


def numbered(docs: DataFrame, name: str = "_sl_uid") -> DataFrame:
    """Rows with a number each that is the same in every job, whatever the splits and executors are.

    A row of a scan of Parquet files (projections and filters on it included) has its file
    and its place in there.  Any other table is written once, together with its numbers.
    """
    if "_metadata" not in (c.lower() for c in docs.columns) and _is_scan(docs):
        try:
            row = F.col("_metadata.row_index")
            place = F.when(row < (1 << ROW_BITS), row).otherwise(F.raise_error(F.lit("a file of more rows than 2**26")).cast("long"))
            path = F.xxhash64(F.regexp_replace("_metadata.file_path", _SCHEME, ""))
            out = docs.withColumn(name, F.shiftleft(F.pmod(path, F.lit(file_modulus(docs.inputFiles()))), ROW_BITS).bitwiseOR(place))
            out.schema  # noqa: B018 - files of another format know no row numbers
            return out
        except AnalysisException:
            pass
    return Scratch(docs.sparkSession, "numbered").keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


@atexit.register
def _clean() -> None:
    for p in _local:
        shutil.rmtree(p, ignore_errors=True)
