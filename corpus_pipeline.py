"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a table with the columns of documents (the last: the packed bins).  ``run``
writes each stage's result as Parquet under the shared folder and reads it again as
the next one's docs, so a lost executor never costs more than the stage at work.

In every stage: null texts count as empty, other columns pass unchanged whatever their
names, rows that repeat a doc_id (or have none) are documents of their own, texts of any
length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import op02_packing, op04_jaccard, op08_mixing, op09_toxicity, op10_exact
from sparkloom.llm.work import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the character model reads these documents, the labels are the table's training fold.

    Empty texts score as the base rate and stay; without labels all stay; ties at the threshold go.
    """
    return op09_toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays; a null doc_id is the least, and of rows equal in both the first by file and row stays.  Null and empty texts are equal."""
    return op10_exact.exact_dedup(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked at a Jaccard similarity of 0.7 the one of the smallest doc_id stays (a null one last, then the first by file and row).  Texts without words link with nothing and stay."""
    return op04_jaccard.near_dedup(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each document and pass, with the words that are taken.  Texts without words are not in it; a null source is a source."""
    return op08_mixing.mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the mix: doc_id, copy, piece, size, source, bin_id.  Passes over one document never share a bin; rows without doc_id conflict with none.  Rows of no words have no bin."""
    return op02_packing.pack(spark, docs, cluster=F.col("doc_id")).select("doc_id", "copy", "piece", "size", "source", "bin_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: A trained classifier's decisions can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = tmp.keep(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
        if k:
            tmp.drop(f"{k - 1}-{STAGES[k - 1][0].replace(' ', '-')}")
    return docs
