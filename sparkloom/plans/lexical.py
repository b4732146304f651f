"""Lexical search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import language_is, path_like, tags_all, tags_any
from sparkloom.operators.bm25 import bm25, bm25_batch, query_terms, term_parts
from sparkloom.sources.tables import table

from .base import query

WORDS, PHRASE, GERMAN = "thtion of the handou onthe erwhes", "the_and of_the", "enpf erch achlich"

TOKENS = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def _tf(parts: list[str], toks: str) -> str:
    if len(parts) == 1:
        return f"len(list_filter({toks}, lambda t: t = '{parts[0]}'))"
    here = " AND ".join(f"{toks}[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"len(list_filter(range(1, greatest(len({toks}) - {len(parts) - 2}, 1)), lambda i: {here}))"


def bm25_sql(text: str, source: str, columns: str, fields: list[str], key: str, k: int, any_term: bool, where: str = "true", tie: str = "") -> str:
    terms = [term_parts(t) for t in query_terms(text)]
    distinct = list(dict.fromkeys(map(tuple, terms)))
    f = [" + ".join(_tf(list(t), f"t{i}") for i in range(len(fields))) for t in distinct]
    idf = [f"CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) > 0 THEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) ELSE 1e-6 END" for j in range(len(f))]
    score = " + ".join(f"{terms.count(list(t))} * ({idf[j]}) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * d / a))" for j, t in enumerate(distinct))
    hit = (" OR " if any_term else " AND ").join(f"f{j} > 0" for j in range(len(f)))
    return f"""
WITH toks AS (SELECT *, {", ".join(f"{TOKENS.format(x)} AS t{i}" for i, x in enumerate(fields))} FROM {source}),
tf AS (SELECT *, {" + ".join(f"len(t{i})" for i in range(len(fields)))} AS d, {", ".join(f"{x} AS f{j}" for j, x in enumerate(f))} FROM toks),
st AS (SELECT count(*)::DOUBLE AS n, avg(d)::DOUBLE AS a, {", ".join(f"sum((f{j} > 0)::INT)::DOUBLE AS n{j}" for j in range(len(f)))} FROM tf)
SELECT {columns}, round({score}, 6) AS score FROM tf, st WHERE ({hit}) AND ({where}) ORDER BY score DESC, {tie}{key} LIMIT {k}"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("bm25_or", bm25_sql(WORDS, "documents", "doc_id, source", ["text"], "doc_id", 20, True))
def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    return bm25(_docs(spark, d), WORDS, "doc_id", ["text"], 20, True, keep=["source"])


@query("bm25_and", bm25_sql("thnt ther thon", "documents", "doc_id, source", ["text"], "doc_id", 20, False))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return bm25(_docs(spark, d), "thnt ther thon", "doc_id", ["text"], 20, keep=["source"])


@query("bm25_phrase", bm25_sql(PHRASE, "documents", "doc_id", ["text"], "doc_id", 20, True))
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return bm25(_docs(spark, d), PHRASE, "doc_id", ["text"], 20, True).select("doc_id", "score")


@query("bm25_lang_prefilter", bm25_sql(GERMAN, "documents", "doc_id, lang", ["text"], "doc_id", 20, True, "lower(lang) IN ('de') AND regexp_matches(source, '^src1')"))
def bm25_lang_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """The filter takes part before the limit; statistics are the whole corpus's."""
    return bm25(_docs(spark, d), GERMAN, "doc_id", ["text"], 20, True, language_is("lang", "de") & path_like("source", "src1*"), keep=["lang"])


@query("bm25_fields", bm25_sql("source src3 thtion", "documents", "doc_id", ["text", "source", "lang"], "doc_id", 20, True))
def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    """Several indexed columns: lengths and frequencies add up over them."""
    return bm25(_docs(spark, d), "source src3 thtion", "doc_id", ["text", "source", "lang"], 20, True).select("doc_id", "score")


_PART = "(SELECT p_partkey, p_name, p_brand, string_split(p_name, ' ') AS tags FROM part)"


@query("bm25_tags", bm25_sql("ring brand 7", _PART, "p_partkey, p_name", ["p_name", "p_brand"], "p_partkey", 20, True, "list_contains(tags, 'red')"))
def bm25_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.split("p_name", " ").alias("tags"))
    return bm25(rows, "ring brand 7", "p_partkey", ["p_name", "p_brand"], 20, True, tags_all("tags", ["red"]), keep=["p_name"])


@query("tags_all_filter", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'bolt')")
def tags_all_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(tags_all(F.split("p_name", " "), ["red", "bolt"])).select("p_partkey", "p_name")


@query("tags_any_filter", "SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['small', 'ring'])")
def tags_any_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(tags_any(F.split("p_name", " "), ["Small", "RING"])).select("p_partkey", "p_name")


_BATCH_TOKENS = TOKENS.format("text")


@query(
    "bm25_batch",
    f"""
WITH toks AS (SELECT doc_id, {_BATCH_TOKENS} AS t FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS a FROM toks),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_BATCH_TOKENS}) AS term FROM benchmark) WHERE length(term) >= 2 GROUP BY ALL),
tf AS (SELECT doc_id, d, term, count(*) AS f FROM (SELECT doc_id, len(t) AS d, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS n1 FROM tf GROUP BY term),
w AS (SELECT term, CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) > 0 THEN ln((n - n1 + 0.5) / (n1 + 0.5)) ELSE 1e-6 END AS w, a FROM df, st),
s AS (SELECT item_id, doc_id, round(sum(times * w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))), 6) AS score FROM q JOIN tf USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def batch(spark: SparkSession, d: str) -> DataFrame:
    return bm25_batch(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 5)


@query(
    "symbol_lookup",
    f"SELECT p_partkey, p_name, score, p_name = 'red bolt' AS exact FROM ({bm25_sql('red bolt', _PART, 'p_partkey, p_name', ['p_name'], 'p_partkey', 5, False)}) ORDER BY exact DESC, score DESC, p_partkey",
)
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The best five by BM25 (all terms), exact names first."""
    best = bm25(table(spark, d, "part").select("p_partkey", "p_name"), "red bolt", "p_partkey", ["p_name"], 5, keep=["p_name"])
    return best.withColumn("exact", F.col("p_name") == "red bolt").orderBy(F.desc("exact"), F.desc("score"), "p_partkey")


@query("glob_language_filter", "SELECT doc_id, source, lang FROM documents WHERE source GLOB 'src1?' AND lower(lang) IN ('en', 'de')")
def glob_language_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(path_like("source", "src1?") & (language_is("lang", "en") | language_is("lang", "de"))).select("doc_id", "source", "lang")
