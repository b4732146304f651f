"""Re-ranking by linear models over token sets, as Column arithmetic.

Candidates are rows with content, and optionally symbol_name, docstring, summary,
search_document, tags, decorators, n_params, param_text, return_type, channel_ranks,
context_match and score (the fused one).  Missing columns count as empty.  The query is
a scalar, so its side of each feature is a literal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import CAMEL, SNAKE, STOP_WORDS, WORD, jaccard, overlap, split_identifier, token_set, trigram_jaccard

LIBRARIES = set(
    """aiohttp asyncio beautifulsoup bs4 celery collections csv cv2 dataclasses django fastapi flask functools huggingface io itertools json jwt matplotlib multiprocessing nltk numpy opencv os pandas pillow
    plotly psycopg2 pydantic pymongo pytest redis requests scikit scrapy seaborn sklearn spacy sqlalchemy sqlite3 subprocess sys tensorflow tf threading toml torch transformers yaml""".split()
)
CHANNELS = dict(graph=1.0, bm25=0.9, vector=0.7)
FEATURES = "func_name import_match ast_struct token_overlap doc_overlap summary_overlap search_doc_overlap symbol_soft param_return channel_boost context_prior rrf_prior".split()
WEIGHTS = {
    "nl": dict(zip(FEATURES, (0.08, 0.04, 0.05, 0.14, 0.20, 0.14, 0.04, 0.10, 0.07, 0.06, 0.0, 0.08))),
    "nl_context": dict(zip(FEATURES, (0.10, 0.02, 0.03, 0.12, 0.16, 0.16, 0.16, 0.12, 0.05, 0.04, 0.03, 0.01))),
    "code": dict(zip(FEATURES, (0.25, 0.20, 0.25, 0.20, 0, 0, 0, 0, 0, 0, 0, 0.10))),
}


def tokens_of(text: str) -> list[str]:
    """The query's token set, as ``token_set`` gives for a column."""
    whole = WORD.findall(text.lower())
    both = dict.fromkeys([*whole, *(p for w in whole for p in w.split("_") if len(p) >= 2)])
    return [t for t in both if len(t) >= 2 and t not in STOP_WORDS]


def names_of(text: str) -> list[str]:
    """Names written in the query: up to three, camelCase before snake_case."""
    found = CAMEL.findall(text) + SNAKE.findall(text)
    return list(dict.fromkeys(found[:3]))


def libraries_of(text: str) -> list[str]:
    low = text.lower()
    return sorted(lib for lib in LIBRARIES if lib in low)


def _arr(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def imports(content: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?:import|from)\s+([A-Za-z0-9_]+)"), F.lit(1))
    return F.array_intersect(F.transform(found, F.lower), _arr(sorted(LIBRARIES)))


#: What short names mean, by a word of the name.  Of no weight in the models; for explanations.
_ALIASES = """add:append,insert,put args:arguments,options auth:authentication,login cfg:configuration,settings cmp:compare,order conn:connection count:length,number,size ctx:context db:database,storage del:delete,remove
dict:mapping,table dir:directory,folder env:environment,variables err:error,failure exec:execute,run fmt:format,text fn:callback,function get:fetch,find,read idx:index,position init:create,prepare,start json:parsed,serialized
len:count,length,size max:greatest,largest,limit min:least,smallest,limit msg:message,text null:empty,missing,none num:count,number obj:object,value opts:arguments,options,settings parse:decode,read req:request res:response,result
run:execute,start set:assign,store,write stat:file,metadata,status str:string,text tmp:temporary to:convert,into url:address,link util:helper val:value"""


def aliases(parts: Column) -> Column:
    """Further words for a name's words."""
    table = {k: v.split(",") for k, v in (x.split(":") for x in _ALIASES.split())}
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _arr(v))])
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.coalesce(F.element_at(pairs, p), _arr([])))))


def features(c: DataFrame, query: str, context_boost: float = 0.03) -> DataFrame:
    """The candidates with a column for each feature."""
    have = set(c.columns)
    get = lambda n, kind="string": F.col(n) if n in have else F.lit(None).cast(kind)
    q, low = _arr(tokens_of(query)), query.lower()
    symbol = F.coalesce(get("symbol_name"), F.lit(""))
    parts = split_identifier(symbol)
    tri = [trigram_jaccard(F.lit(n), symbol) for n in names_of(query)]
    soft = overlap(q, parts)
    func = F.greatest(F.lit(0.0), F.least(F.lit(0.9), soft), *tri)
    libs = libraries_of(query)
    lib = F.size(F.array_intersect(_arr(libs), imports(get("content")))) / len(libs) if libs else F.lit(0.0)
    tags = F.coalesce(get("tags", "array<string>"), _arr([]))
    ast = F.lit(0.0)
    if any(w in low for w in ("async", "await", "coroutine")):
        ast = ast + F.when(F.array_contains(tags, "async"), 0.4).otherwise(0.0)
    if any(w in low for w in ("decorat", "wraps")) and ("decorator" in low or "decorated" in low or "wraps" in low):
        ast = ast + F.when(F.size(F.coalesce(get("decorators", "array<string>"), _arr([]))) > 0, 0.3).otherwise(0.0)
    if any(w in low for w in ("annotation", "return type", "type hint", "typed")):
        ast = ast + F.when(F.array_contains(tags, "type_hint") | (F.coalesce(get("return_type"), F.lit("")) != ""), 0.3).otherwise(0.0)
    hint = 3 if any(w in low for w in ("many", "multiple", "several")) else 1 if "single" in low or "one parameter" in low else 0
    if hint:
        ast = ast + F.greatest(F.lit(0.0), 0.3 - 0.1 * F.abs(hint - F.coalesce(get("n_params", "int"), F.lit(0))))
    ranks = get("channel_ranks", "map<string,int>")
    channel = F.least(F.lit(1.0), F.greatest(F.lit(0.0), *[F.coalesce(w / F.element_at(ranks, n), F.lit(0.0)) for n, w in CHANNELS.items()]))
    match = F.coalesce(get("context_match", "double"), F.lit(0.0))
    return c.select(
        "*",
        func.alias("func_name"),
        lib.cast("double").alias("import_match"),
        F.least(ast, F.lit(1.0)).alias("ast_struct"),
        overlap(q, token_set(get("content"))).alias("token_overlap"),
        overlap(q, token_set(get("docstring"))).alias("doc_overlap"),
        overlap(q, token_set(get("summary"))).alias("summary_overlap"),
        overlap(q, token_set(get("search_document"))).alias("search_doc_overlap"),
        soft.alias("symbol_soft"),
        overlap(q, F.array_union(token_set(get("param_text")), token_set(get("return_type")))).alias("param_return"),
        channel.alias("channel_boost"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), match * context_boost * 10)).alias("context_prior"),
        F.least(F.coalesce(get("score", "double"), F.lit(0.0)), F.lit(1.0)).alias("rrf_prior"),
        overlap(q, F.array_union(F.array_union(token_set(get("qualified_name")), token_set(get("file_path"))), token_set(get("owner_text")))).alias("owner_match"),
        overlap(q, aliases(parts)).alias("alias_match"),
        match.alias("_match"),
    )


def rerank(c: DataFrame, query: str, nl: bool, top_k: int = 10, keep_tail: bool | None = None, path: str = "file_path", digits: int = 9) -> DataFrame:
    """The best ``top_k`` candidates by the model, with ``rerank_score`` and ``stage``; in natural-language mode the others follow with their fused score."""
    f = features(c, query)
    score = lambda w: reduce(lambda a, b: a + b, (F.col(n) * F.lit(float(v)) for n, v in WEIGHTS[w].items() if v))
    model = F.when(F.col("_match") != 0, score("nl_context")).otherwise(score("nl")) if nl else score("code")
    none = (F.coalesce(F.col("symbol_name"), F.lit("")) == "") & (F.size(F.coalesce(F.col("tags"), _arr([]))) == 0) if {"symbol_name", "tags"} <= set(c.columns) else F.lit(False)
    scored = f.withColumn("rerank_score", F.round(F.when(none, 0.1 * F.col("score")).otherwise(model), digits))
    order = [F.desc("rerank_score"), F.lower(F.replace(F.coalesce(F.col(path), F.lit("")), F.lit("\\"), F.lit("/"))), F.lower(F.coalesce(F.col("symbol_name"), F.lit(""))) if "symbol_name" in c.columns else F.lit(""), F.col("id").cast("string")]
    top = scored.orderBy(*order).limit(top_k).withColumn("stage", F.lit("rerank")).drop("_match")
    if not (nl if keep_tail is None else keep_tail):
        return top
    tail = scored.drop("_match").withColumn("rerank_score", F.round("score", digits)).withColumn("stage", F.lit("fused")).join(top.select("id"), "id", "left_anti").select(*top.columns)
    return top.unionByName(tail)


V2_STOP = set("a an and are as at be by can could did do does for from get had has have in is it may might not of on or set shall should that the this to use used using was were will with would".split())


def rerank_v2(c: DataFrame, query: str, digits: int = 9) -> DataFrame:
    """The six-feature model: exact name, imports, kind, fused score, word Jaccard, cosine."""
    low = query.lower()
    q = sorted(set(WORD.findall(low)))
    name = F.lower(F.coalesce(F.col("symbol_name"), F.lit("")))
    parts = F.regexp_extract_all(name, F.lit("([a-z0-9_]+)"), F.lit(1))
    written = [n.lower() for n in CAMEL.findall(query) + SNAKE.findall(query)]
    named = reduce(lambda a, b: a | b, [(name == n) | (F.contains(name, F.lit(n)) if len(n) >= 4 else F.lit(False)) for n in written], F.lit(False))
    f1 = F.when(named, 1.0).when(F.length(name) < 2, 0.0).when(F.instr(F.lit(low), name) > 0, 1.0).when(F.size(F.array_except(parts, _arr(q))) == 0, 0.8).otherwise(0.0)
    f2 = F.when(F.arrays_overlap(_arr(libraries_of(query)), imports(F.col("content"))), 1.0).otherwise(0.0)
    hints = {"function": ("def ", "function", "method", "func"), "class": ("class ", "object"), "variable": ("var", "variable", "const", "constant")}
    wanted = next((t for t, hs in hints.items() if any(h in low for h in hs)), None)
    f3 = F.when(F.col("symbol_type") == wanted, 1.0).otherwise(0.0) if wanted else F.when(F.col("symbol_type") == "function", 0.3).otherwise(0.0)
    s = F.col("score")
    f4 = F.when(s < 0, 1 / (1 + F.abs(s))).when(s <= 1, s).otherwise(1 / (1 + s))
    have = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.col("content")), F.lit("([a-z0-9_]+)"), F.lit(1))), _arr(sorted(V2_STOP)))
    f5 = jaccard(_arr([t for t in q if t not in V2_STOP]), have) if [t for t in q if t not in V2_STOP] else F.lit(0.0)
    f6 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("vec_sim") if "vec_sim" in c.columns else F.lit(0.0), F.lit(0.0))))
    total = 0.35 * f1 + 0.25 * f2 + 0.15 * f3 + 0.15 * f4 + 0.07 * f5 + 0.03 * f6
    return c.withColumn("rerank_score", F.round(total, digits))
