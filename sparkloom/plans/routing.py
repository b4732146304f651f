"""Routing of the users' turns in conversations, and of probes whose route is known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import routing as R
from sparkloom.sources.tables import table

from .base import query

PROBES = [
    "def read_json(path):",
    "read_json_file",
    "1. **Purpose**: reads a file and lists its expected errors for the caller of the thing",
    "Bug report: the importer crashes with TypeError when the header is missing from the file",
    "for each user find the login",
    "who calls parse_config",
    "what happens if I remove load_user",
    "where is the session class",
    "explain the retry flow",
    "write a function to parse json files and return a list of paths",
    "read ascii.rst tables in reStructuredText",
    "obj.method",
    "how does caching work",
    "traceback when the app does not start at all",
    "find HttpClient",
    "",
    "numpy matrix multiplication",
]


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PROBES = "(SELECT unnest([" + ", ".join(_lit(p) for p in PROBES) + "]) AS query)"
_TURNS = "(SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user')"


def _any(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_lit(n)})" for n in needles) + ")"


def _count(c: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {_lit(n)})::INT" for n in needles) + ")"


_CODE = f"regexp_matches(regexp_extract(query, '^\\s*([^\\n]*)', 1), {_lit(R.CODE_START)})"
_N = "len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))"
_LOW = "lower(query)"
TYPE_SQL = f"""CASE WHEN NOT {_CODE} AND {_any(_LOW, R.PURPOSE)} THEN 'nl'
WHEN NOT {_CODE} AND {_N} >= 5 AND ({_any(_LOW, R.TYPE_STRONG)} OR {_count(_LOW, R.TYPE_WEAK)} >= 1) THEN 'nl'
WHEN NOT {_CODE} AND {_N} >= 18 THEN 'nl' WHEN {_CODE} THEN 'code'
WHEN contains(query, chr(10)) AND regexp_matches(query, {_lit(R.CODE_INSIDE)}) THEN 'code'
WHEN {_N} >= 5 AND NOT regexp_matches(query, '[;={{}}()_]|::') THEN 'nl'
WHEN contains(query, '_') OR regexp_matches(query, '[a-z][A-Z]') OR contains(query, '(') OR contains(query, '::') THEN 'code'
WHEN contains(query, '.') AND (regexp_matches(query, '\\.[a-zA-Z]') OR length(query) - length(replace(query, '.', '')) >= 2) THEN 'code' ELSE 'nl' END"""
PROFILE_SQL = f"""CASE WHEN {_CODE} THEN 'code' WHEN {_any(_LOW, R.PURPOSE)} THEN 'function_memory'
WHEN {_any(_LOW, R.ISSUE_STRONG)} OR ({_N} >= 10 AND {_count(_LOW, R.ISSUE_WEAK)} >= 2) THEN 'issue'
WHEN ({TYPE_SQL}) = 'code' THEN 'code' ELSE 'function_memory' END"""


_ALL = f"(SELECT query FROM {_PROBES} UNION SELECT query FROM {_TURNS})"


def _all(spark: SparkSession, d: str) -> DataFrame:
    """The probes and every user turn, each query once."""
    return _probes(spark).unionByName(_turns(spark, d).select("query")).distinct()


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROBES], T.StructType([T.StructField("query", T.StringType())]))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


@query("route_type", f"SELECT conv_id, turn, {TYPE_SQL} AS query_type FROM {_TURNS}")
def route_type(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", R.query_type("query").alias("query_type"))


@query("route_profile", f"SELECT conv_id, turn, {PROFILE_SQL} AS profile FROM {_TURNS}")
def route_profile(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", R.query_profile("query").alias("profile"))


@query("route_probes", f"SELECT query, {TYPE_SQL} AS query_type, {PROFILE_SQL} AS profile, CASE WHEN ({PROFILE_SQL}) = 'issue' THEN 0.3 ELSE 0.9 END::DOUBLE AS w_graph, CASE WHEN ({PROFILE_SQL}) = 'issue' THEN 0.5 ELSE 0.05 END::DOUBLE AS w_vector, CASE WHEN ({PROFILE_SQL}) = 'issue' THEN 0.2 ELSE 0.05 END::DOUBLE AS w_bm25 FROM {_PROBES}")
def route_probes(spark: SparkSession, d: str) -> DataFrame:
    w = R.weights("query")
    return _probes(spark).select("query", R.query_type("query").alias("query_type"), R.query_profile("query").alias("profile"), w["graph"].alias("w_graph"), w["vector"].alias("w_vector"), w["bm25"].alias("w_bm25"))


_Q = "trim(coalesce(query, ''))"
_CASES = [(n, p) for n, ps in R.INTENTS for p in ps]
_INTENT = f"CASE WHEN {_Q} = '' THEN 'semantic' " + " ".join(f"WHEN regexp_matches({_Q}, {_lit(p)}, 'i') THEN '{n}'" for n, p in _CASES) + " ELSE 'semantic' END"
_ENTITY = f"CASE WHEN {_Q} = '' THEN '' " + " ".join(f"WHEN regexp_matches({_Q}, {_lit(p)}, 'i') THEN trim(coalesce(regexp_extract({_Q}, {_lit(p)}, 1, 'i'), ''))" for _, p in _CASES) + " ELSE '' END"
_SURE = f"CASE WHEN {_Q} = '' THEN 0.3 " + " ".join(f"WHEN regexp_matches({_Q}, {_lit(p)}, 'i') THEN 0.8" for _, p in _CASES) + " ELSE 0.5 END::DOUBLE"


@query("route_intent", f"SELECT query, {_INTENT} AS intent, {_ENTITY} AS entity, {_SURE} AS confidence FROM {_ALL}")
def route_intent(spark: SparkSession, d: str) -> DataFrame:
    i = R.intent("query")
    return _all(spark, d).select("query", i["intent"].alias("intent"), i["entity"].alias("entity"), i["confidence"].alias("confidence"))


@query("intent_counts", f"SELECT {_INTENT} AS intent, count(*)::BIGINT AS queries FROM {_TURNS} GROUP BY 1")
def intent_counts(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select(R.intent("query")["intent"].alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("queries"))


def _expansion_sql() -> str:
    lists = " || ".join(f"CASE WHEN regexp_matches(query, {_lit(p)}, 'i') THEN [{', '.join(map(_lit, t))}] ELSE []::VARCHAR[] END" for p, t in R.EXPANSION)
    return f"SELECT query, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS expansion FROM (SELECT query, {lists} AS l FROM {_ALL})"


@query("query_expand", _expansion_sql())
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("query", F.array_join(R.expansion_tokens("query"), " ").alias("expansion"))


@query("nl_symbol_candidates")
def nl_symbol_candidates(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(q, k, s) for q in rows["query"] for k, s in enumerate(R.symbol_candidates(q or "", {"numpy", "json"}))]
            yield pd.DataFrame(found, columns=["query", "position", "candidate"])

    return _all(spark, d).mapInPandas(run, "query string, position int, candidate string")
