"""BM25 over one or several text columns.

With N rows, row length d (tokens of all indexed columns), average length a, and for
each query term n rows that hold it and f occurrences in a row:

    idf = ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that isn't positive
    score = sum of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))

A term with ``_`` is a phrase: its parts next to each other in one column.  A term
that is given twice counts twice.  Corpus statistics always cover the whole table;
filters on rows come after them.

A single query needs no index and no shuffle: one scan counts terms, keeps the counts of
matching rows (without texts) and observes the corpus statistics; the top rows are then
taken from each partition first.  Many queries at once meet the scan as one matrix.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import WORD, fold_accents, index_tokens
from sparkloom.sources.tables import cut, spread

K1, B = 1.2, 0.75
#: Words that a query leaves out, beside those of one character.
QUERY_STOP = set("a an and are as at be been but by do does did for from had has have he her his how i in is it its not of on or that the their this to was we were what when which who will with you".split())
MOST_TERMS = 96
QUERY_BYTES = 64 << 20


def query_terms(query: str, keep_stop_words: bool = False) -> list[str]:
    found = [t for t in WORD.findall(query) if len(t) >= 2]
    kept = found if keep_stop_words else [t for t in found if t.lower() not in QUERY_STOP]
    return (kept or found)[:MOST_TERMS]


def term_parts(term: str) -> list[str]:
    return [p for p in re.split(r"[^0-9a-z]+", term.lower()) if p]


def _line(text: str) -> Column:
    """The tokens of a column, in order, with two spaces between."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.coalesce(F.col(text), F.lit("")))), r"[^\p{L}\p{N}]+", "  "))


def _tokens(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(_times(line, "  ") + 1)


def _times(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def _occurrences(line: Column, parts: list[str]) -> Column:
    """How often the parts follow one another; a phrase may overlap itself."""
    inside = F.concat(F.lit(" "), line, F.lit(" "))
    if any(parts[:k] == parts[-k:] for k in range(1, len(parts))):
        return F.regexp_count(inside, F.lit(" (?=" + "  ".join(parts) + " )"))
    return _times(inside, " " + "  ".join(parts) + " ")


def idf(total: Column, holding: Column) -> Column:
    raw = F.log((total - holding + 0.5) / (holding + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def part(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(docs: DataFrame, query: str, key: str, fields: list[str], k: int | None = None, or_semantics: bool = False, where: Column | None = None, digits: int = 6, tie: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows that match (any term, or all): key, the ``keep`` columns and ``score`` (higher is better); the best k of them, ties by ``tie`` and key."""
    out = list(dict.fromkeys([key, *(keep or []), *(tie or [])]))
    terms = [p for p in map(term_parts, query_terms(query)) if p]
    if not terms:
        return docs.select(*out).withColumn("score", F.lit(0.0)).limit(0)
    distinct = [list(t) for t in dict.fromkeys(map(tuple, terms))]
    times = [terms.count(t) for t in distinct]
    passes = where if where is not None else F.lit(True)
    lines = spread(docs).select(*out, passes.alias("_ok"), *(_line(f).alias(f"_t{i}") for i, f in enumerate(fields)))
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    each = range(len(fields))
    counted = lines.select(*out, "_ok", add(_tokens(F.col(f"_t{i}")) for i in each).alias("_len"), *(add(_occurrences(F.col(f"_t{i}"), t) for i in each).alias(f"_f{j}") for j, t in enumerate(distinct)))
    # statistics are observed on the way to the matching rows, so texts are read once
    seen = Observation()
    watched = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_len"), F.lit(0)).alias("len"), *(F.coalesce(F.sum((F.col(f"_f{j}") > 0).cast("long")), F.lit(0)).alias(f"n{j}") for j in range(len(distinct))))
    hit = reduce(lambda a, b: (a | b) if or_semantics else (a & b), (F.col(f"_f{j}") > 0 for j in range(len(distinct))))
    rows = cut(watched.filter(hit & F.coalesce(F.col("_ok"), F.lit(False))).select(*out, "_len", *(f"_f{j}" for j in range(len(distinct)))))
    s = seen.get
    n, average = F.lit(float(s["n"])), F.lit(float(s["len"]) / max(1, s["n"]))
    total = add(times[j] * part(idf(n, F.lit(float(s[f"n{j}"]))), F.col(f"_f{j}"), F.col("_len"), average) for j in range(len(distinct)))
    scored = rows.select(*out, F.round(total, digits).alias("score"))
    order = [F.desc("score"), *(tie or []), key]
    return scored.orderBy(*order).limit(k) if k else scored


def _hits(vocabulary: dict[str, int]):
    """(length, term numbers, their counts) of each token line."""

    def of(line: str) -> tuple[int, np.ndarray, np.ndarray]:
        words = line.split()
        found = np.array([n for n in map(vocabulary.get, words) if n is not None], np.int64)
        return len(words), *np.unique(found, return_counts=True)

    return of


def _frequencies(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, df, rows, length = _hits(vocabulary), np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for line in batch.column(1).to_pylist():
                n, t, _ = of(line)
                df[t] += 1
                rows, length = rows + 1, length + n
        at = np.flatnonzero(df)
        # rows and lengths travel as terms -1 and -2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [rows, length]]))], ["term", "n"])

    return run


def _best(vocabulary: dict[str, int], weights: np.ndarray, ids: np.ndarray, average: float, k: int, digits: int, key: str):
    """weights: terms x queries, times in the query * idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _hits(vocabulary)
        top_s, top_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            keys, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo in range(0, len(lines), 256):
                s = np.zeros((len(ids), len(lines[lo : lo + 256])))
                for j, line in enumerate(lines[lo : lo + 256]):
                    n, t, f = of(line)
                    s[:, j] = (f * (K1 + 1) / (f + K1 * (1 - B + B * n / average))) @ weights[t]
                both, who = np.concatenate([top_s, np.round(s, digits)], 1), np.concatenate([top_i, np.broadcast_to(keys[lo : lo + 256], s.shape)], 1)
                order = np.lexsort((who, -both), axis=1)[:, :k]
                top_s, top_i = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        q, at = np.nonzero(top_s > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(top_i[q, at]), pa.array(top_s[q, at])], ["query_id", key, "score"])

    return run


def bm25_batch(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The best k documents for each row of ``queries`` (any term; single tokens): query_key, key (both long), score, rank.

    Queries go to the scan in blocks whose term-by-query matrix has at most ``QUERY_BYTES``;
    one scan counts the terms, a second scores and keeps each partition's best k a query.
    No posting is shuffled.  A block after another is read, however many there are.
    """
    lines = spread(docs.select(F.col(key).cast("long").alias(key), text)).select(key, _line(text).alias("line"))
    asked = queries.select(F.col(query_key).cast("long").alias("q"), F.filter(index_tokens(query_text), lambda t: F.length(t) >= 2).alias("t"))
    blocks: list[list[tuple[int, Counter]]] = [[]]
    seen: set[str] = set()
    out = None
    for r in asked.orderBy("q").toLocalIterator():  # a partition of queries at a time
        more = seen | set(r["t"])
        if blocks[-1] and len(more) * (len(blocks[-1]) + 1) * 8 > QUERY_BYTES:
            blocks.append([])
            more = set(r["t"])
        seen = more
        blocks[-1].append((r["q"], Counter(r["t"])))
    for block in blocks:
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, c in block for t in c}))}
        names = list(vocabulary)
        got = lines.mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # a row for each term
        n = dict(zip(got["term"], got["n"]))
        total, average = n.get(-1, 0), n.get(-2, 0) / max(1, n.get(-1, 0))
        weights = np.zeros((len(names), len(block)))
        for j, (_, c) in enumerate(block):
            for t, times in c.items():
                held = n.get(vocabulary[t], 0)
                raw = math.log((total - held + 0.5) / (held + 0.5))
                weights[vocabulary[t], j] = times * (raw if raw > 0 else 1e-6)
        part_ = lines.mapInArrow(_best(vocabulary, weights, np.array([q for q, _ in block], np.int64), max(average, 1e-9), k, digits, key), f"query_id long, {key} long, score double")
        out = part_ if out is None else out.unionByName(part_)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).withColumnRenamed("query_id", query_key)
