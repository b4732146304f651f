"""Features and re-ranking.  Candidates are the best documents by BM25; source and language make a symbol name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import rerank as R
from sparkloom.operators.bm25 import bm25
from sparkloom.sources.tables import spread, table

from .base import query
from .lexical import WORDS, bm25_sql

ASK = "find the src3_en thtion of a json import for multiple wraps typed handouOnthe"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


_STOP = _list(X.STOP_WORDS)


def _tokens(c: str) -> str:
    w = f"regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9_]+')"
    return f"list_filter(list_distinct({w} || list_filter(flatten(list_transform({w}, lambda t: string_split(t, '_'))), lambda t: length(t) >= 2)), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


def _overlap(q: str, c: str) -> str:
    return f"CASE WHEN len({q}) > 0 AND len({c}) > 0 THEN len(list_intersect({q}, {c}))::DOUBLE / len({q}) ELSE 0.0 END"


def _split(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '([0-9a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]', ' ', 'g')), '[a-z0-9]+'), lambda t: length(t) >= 2)"


def _tri(c: str) -> str:
    return f"CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) ELSE []::VARCHAR[] END"


def _jac(a: str, b: str) -> str:
    n = f"len(list_distinct({a} || {b}))"
    return f"CASE WHEN {n} > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / {n} ELSE 0.0 END"


_NAME = "p_brand || p_type || '_' || p_name"


@query("identifier_split", f"SELECT p_partkey, array_to_string({_split(_NAME)}, ' ') AS words FROM part")
def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_brand", "p_type", F.lit("_"), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.split_identifier(name), " ").alias("words"))


@query("token_overlap", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, round({_overlap(_list(R.tokens_of(WORDS)), 't')}, 6)::DOUBLE AS overlap FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.token_set("text").alias("t"))
    q = F.array(*[F.lit(x) for x in R.tokens_of(WORDS)])
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.round(X.overlap(q, F.col("t")), 6).alias("overlap"))


@query("trigram_jaccard", f"SELECT p_partkey, round({_jac(_tri('p_name'), _tri('p_type'))}, 6)::DOUBLE AS same, round({_jac(_tri('p_name'), _tri(chr(39) + 'red_ringlet' + chr(39)))}, 6)::DOUBLE AS probe FROM part")
def trigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(X.trigram_jaccard("p_name", "p_type"), 6).alias("same"), F.round(X.trigram_jaccard("p_name", F.lit("red_ringlet")), 6).alias("probe"))


_LIBS = _list(sorted(R.LIBRARIES))
_IMPORTS = f"list_sort(list_distinct(list_intersect(list_transform(regexp_extract_all(x, '(?:import|from)\\s+([A-Za-z0-9_]+)', 1), lambda t: lower(t)), {_LIBS})))"


@query("import_match", f"SELECT p_partkey, array_to_string({_IMPORTS}, ',') AS imports FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'import json' WHEN 1 THEN 'from numpy import array; import os' WHEN 2 THEN 'import unknown' ELSE p_name END AS x FROM part)")
def import_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    code = F.when(k == 0, "import json").when(k == 1, "from numpy import array; import os").when(k == 2, "import unknown").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(R.imports(code))), ",").alias("imports"))


_CANDS = f"""cand AS (SELECT doc_id AS id, text AS content, source || '_' || lang AS symbol_name, substr(text, 1, 200) AS docstring, source AS file_path, [lang, 'type_hint'] AS tags, score / 100 AS score, CASE WHEN lang = 'de' THEN 0.6 ELSE 0.0 END::DOUBLE AS context_match,
row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({bm25_sql(WORDS, 'documents', 'doc_id, text, source, lang', ['text'], 'doc_id', 30, True)}))"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    b = docs.join(F.broadcast(bm25(docs, WORDS, "doc_id", ["text"], 30, True)), "doc_id")  # 30 rows
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return b.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat_ws("_", "source", "lang").alias("symbol_name"), F.substring("text", 1, 200).alias("docstring"), F.col("source").alias("file_path"),
        F.array("lang", F.lit("type_hint")).alias("tags"), (F.col("score") / 100).alias("score"), F.when(F.col("lang") == "de", 0.6).otherwise(0.0).alias("context_match"), F.create_map(F.lit("bm25"), rank).alias("channel_ranks"), F.lit("function").alias("symbol_type"),
    )


_Q = _list(R.tokens_of(ASK))
_NAMES = R.names_of(ASK)
_SOFT = _overlap(_Q, _split("symbol_name"))
_FUNC = "greatest(0.0, least(0.9, " + _SOFT + ")" + "".join(", " + _jac(_tri("'" + n + "'"), _tri("symbol_name")) for n in _NAMES) + ")"
_LIB = R.libraries_of(ASK)
_IMP = f"len(list_intersect({_list(_LIB)}, list_transform(regexp_extract_all(content, '(?:import|from)\\s+([A-Za-z0-9_]+)', 1), lambda t: lower(t))))::DOUBLE / {max(1, len(_LIB))}"
_AST = "least(1.0, CASE WHEN list_contains(tags, 'type_hint') THEN 0.3 ELSE 0.0 END + greatest(0.0, 0.3 - 0.1 * 3))"
_F = {"func_name": _FUNC, "import_match": _IMP, "ast_struct": _AST, "token_overlap": _overlap(_Q, _tokens("content")), "doc_overlap": _overlap(_Q, _tokens("docstring")), "symbol_soft": _SOFT, "channel_boost": "least(1.0, 0.9 / rank)", "context_prior": "least(1.0, context_match * 0.3)", "rrf_prior": "least(score, 1.0)"}


def _score(mode: str) -> str:
    return " + ".join(f"{w}::DOUBLE * ({_F[n]})" for n, w in R.WEIGHTS[mode].items() if w and n in _F)


@query("rerank_features", f"WITH {_CANDS} SELECT id, " + ", ".join(f"round({e}, 6)::DOUBLE AS {n}" for n, e in _F.items()) + " FROM cand")
def rerank_features(spark: SparkSession, d: str) -> DataFrame:
    f = R.features(candidates(spark, d), ASK)
    return f.select("id", *[F.round(n, 6).cast("double").alias(n) for n in _F])


_ORDER = "rerank_score DESC, lower(file_path), lower(symbol_name), id::VARCHAR"


@query("rerank_v1_code", f"WITH {_CANDS} SELECT id, round({_score('code')}, 6) AS rerank_score FROM cand ORDER BY {_ORDER} LIMIT 10")
def rerank_v1_code(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(candidates(spark, d), ASK, nl=False, digits=6).select("id", "rerank_score")


@query(
    "rerank_v1_nl",
    f"""WITH {_CANDS}, s AS (SELECT *, round(CASE WHEN context_match <> 0 THEN {_score('nl_context')} ELSE {_score('nl')} END, 6) AS rerank_score FROM cand), t AS (SELECT * FROM s ORDER BY {_ORDER} LIMIT 10)
SELECT id, rerank_score, 'rerank' AS stage FROM t UNION ALL SELECT id, round(score, 6), 'fused' FROM cand WHERE id NOT IN (SELECT id FROM t)""",
)
def rerank_v1_nl(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(candidates(spark, d), ASK, nl=True, digits=6).select("id", "rerank_score", "stage")


_V2Q = _list(sorted({t for t in X.WORD.findall(ASK.lower())}))
_V2Q_F = _list(sorted({t for t in X.WORD.findall(ASK.lower())} - R.V2_STOP))
_V2HAVE = f"list_filter(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+')), lambda t: NOT list_contains({_list(sorted(R.V2_STOP))}, t))"
_V2NAMED = " OR ".join(f"lower(symbol_name) = '{n.lower()}' OR contains(lower(symbol_name), '{n.lower()}')" for n in [*X.CAMEL.findall(ASK), *X.SNAKE.findall(ASK)]) or "false"


@query(
    "rerank_v2",
    f"""WITH {_CANDS} SELECT id, round(0.35::DOUBLE * (CASE WHEN {_V2NAMED} THEN 1.0 WHEN length(symbol_name) < 2 THEN 0.0 WHEN contains('{ASK.lower()}', lower(symbol_name)) THEN 1.0
WHEN len(list_filter(regexp_extract_all(lower(symbol_name), '[a-z0-9_]+'), lambda t: NOT list_contains({_V2Q}, t))) = 0 THEN 0.8 ELSE 0.0 END)
+ 0.25::DOUBLE * (CASE WHEN list_has_any({_list(_LIB)}, list_transform(regexp_extract_all(content, '(?:import|from)\\s+([A-Za-z0-9_]+)', 1), lambda t: lower(t))) THEN 1.0 ELSE 0.0 END)
+ 0.15::DOUBLE * 0.3 + 0.15::DOUBLE * score + 0.07::DOUBLE * ({_jac(_V2Q_F, _V2HAVE)}), 6) AS rerank_score FROM cand""",
)
def rerank_v2(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank_v2(candidates(spark, d), ASK, 6).select("id", "rerank_score")


@query("path_functions", "SELECT url, regexp_replace(regexp_replace(regexp_replace(u, '\\.[^./\\\\]+$', ''), '^[./\\\\]+', ''), '[/\\\\]+', '.', 'g') AS module, sha1(url) AS sha1, substr(sha256(url), 1, 16) AS short FROM (SELECT url, regexp_replace(url, '^https?://', '') AS u FROM pages)")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").select("url", X.module_of_path(u).alias("module"), F.sha1("url").alias("sha1"), X.short_hash("url").alias("short"))
