"""Index building and upkeep: parsing, search documents, merges, work lists, caches, data flow, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import documents as D
from sparkloom.functions.text import file_glob, language_of_path, path_like
from sparkloom.operators import context as C
from sparkloom.operators import dataflow as FL
from sparkloom.sources import lookup, parse, sample, store
from sparkloom.sources.embedding import HashingProvider, embed
from sparkloom.sources.tables import cut, spread, table
from sparkloom.streaming.watch import windowed_counts

from .base import query
from .features import _list
from .graphs import IMPACT_SQL, START, links
from .lexical import bm25_sql


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(sample.FILES.items()), "path string, content string")


def parsed(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse.parse_files(files(spark))


@query("parse_chunks")
def parse_chunks(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark)[0]


@query("parse_symbols")
def parse_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark)[1]


@query("parse_calls")
def parse_calls(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark)[2]


@query("search_document")
def search_document(spark: SparkSession, d: str) -> DataFrame:
    c, s, _ = parsed(spark)
    return D.search_documents(c, s)


@query("comment_extract")
def comment_extract(spark: SparkSession, d: str) -> DataFrame:
    return files(spark).select("path", D.comments("content").alias("comments"), D.import_lines("content").alias("imports"))


@query("embed_chunks")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    c, s, _ = parsed(spark)
    return embed(cut(D.search_documents(c, s)).withColumn("t", D.embedding_text("search_text")), "chunk_id", "t", HashingProvider(64))


#: Documents as Python files, and each one's longest word as a function with one parameter of that name.
_FILES_SQL = """
f AS (SELECT 'd' || doc_id || '.py' AS path, coalesce(text, '') AS content FROM documents),
ln AS (SELECT path, unnest(range(1, len(l) + 1))::INT AS line_number, unnest(list_transform(l, lambda x: trim(x, ' '))) AS line FROM (SELECT path, regexp_split_to_array(content, '\\r?\\n') AS l FROM f)),
tg AS (SELECT *, CASE WHEN contains(line, '=') AND regexp_matches(t, '^[\\p{L}_]') THEN t END AS target FROM (SELECT *, trim(split_part(trim(split_part(trim(split_part(line, '=', 1), ' '), ',', 1), ' '), ':', 1), ' ') AS t FROM ln)),
k AS (SELECT path, line_number, target, unnest(list_distinct(""" + " || ".join(f"CASE WHEN contains(line, '{p}') THEN ['{t}'] ELSE []::VARCHAR[] END" for p, t in FL.INPUTS.items()) + """)) AS source FROM tg WHERE target IS NOT NULL),
inputs AS (SELECT DISTINCT source, path || ':' || target AS sink, path AS file_path, line_number FROM k),
vr AS (SELECT path, line_number, CASE WHEN trim(regexp_extract(line, 'isinstance\\(([^,]*),', 1), ' ') <> '' THEN trim(regexp_extract(line, 'isinstance\\(([^,]*),', 1), ' ') WHEN trim(regexp_extract(line, 'type\\(([^)]*)\\)', 1), ' ') <> '' THEN trim(regexp_extract(line, 'type\\(([^)]*)\\)', 1), ' ')
  WHEN regexp_extract(line, '(\\S+)\\s*\\.validate', 1) <> '' THEN regexp_extract(line, '(\\S+)\\s*\\.validate', 1) END AS var, CASE WHEN """ + " OR ".join(f"contains(line, '{x}')" for x in FL.FULL) + """ THEN 'full' WHEN contains(line, 'isinstance') OR contains(line, 'type(') OR contains(line, 'assert ') THEN 'type_check' END AS level FROM ln),
lv AS (SELECT i.source, i.sink, i.file_path, i.line_number, arg_max(v.level, v.line_number) AS level FROM inputs i JOIN vr v ON v.path = i.file_path AND v.var IS NOT NULL AND v.level IS NOT NULL AND (contains(i.sink, v.var) OR contains(i.source, v.var)) GROUP BY ALL),
wash AS (SELECT DISTINCT path, target AS var FROM tg WHERE target IS NOT NULL AND (""" + " OR ".join(f"contains(line, '{x}')" for x in FL.CLEANERS) + """)),
cl AS (SELECT DISTINCT i.source, i.sink, i.file_path, i.line_number FROM inputs i JOIN wash w ON w.path = i.file_path AND (contains(i.sink, w.var) OR contains(i.source, w.var))),
flows AS (SELECT i.*, coalesce(lv.level, 'none') AS validation_level, cl.source IS NOT NULL AS sanitized FROM inputs i LEFT JOIN lv USING (source, sink, file_path, line_number) LEFT JOIN cl USING (source, sink, file_path, line_number))"""


def document_flows(spark: SparkSession, d: str) -> DataFrame:
    """The outside inputs in all documents, read as Python lines."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    none = spark.createDataFrame([], parsed(spark)[1].schema)
    return FL.flows(rows, none).select("source", "sink", "file_path", "line_number", "validation_level", "sanitized").distinct()


@query("dataflow_inputs", f"WITH {_FILES_SQL} SELECT source, sink, file_path, line_number FROM flows")
def dataflow_inputs(spark: SparkSession, d: str) -> DataFrame:
    return document_flows(spark, d).select("source", "sink", "file_path", "line_number")


@query("dataflow_validation", f"WITH {_FILES_SQL} SELECT source, validation_level, sanitized, count(*)::BIGINT AS flows FROM flows GROUP BY ALL")
def dataflow_validation(spark: SparkSession, d: str) -> DataFrame:
    return document_flows(spark, d).groupBy("source", "validation_level", "sanitized").agg(F.count(F.lit(1)).alias("flows"))


@query("unvalidated_inputs", f"WITH {_FILES_SQL} SELECT file_path, count(*)::BIGINT AS inputs FROM flows WHERE validation_level = 'none' GROUP BY file_path")
def unvalidated_inputs(spark: SparkSession, d: str) -> DataFrame:
    return FL.unvalidated_inputs(document_flows(spark, d)).groupBy("file_path").agg(F.count(F.lit(1)).alias("inputs"))


@query("dataflow_sample")
def dataflow_sample(spark: SparkSession, d: str) -> DataFrame:
    return FL.flows(files(spark), parsed(spark)[1])


@query("html_title_chunks", "SELECT url || '#' || trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) AS id, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) AS docstring, (length(html) - length(replace(html, chr(10), '')) + 1)::BIGINT AS end_line FROM pages")
def html_title_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = D.html_title("html")
    return table(spark, d, "pages").select(F.concat_ws("#", "url", t).alias("id"), t.alias("docstring"), F.size(F.split("html", "\n", -1)).cast("long").alias("end_line"))


def _tags_sql(c: str) -> str:
    any_ = lambda ns: " OR ".join("contains(x, '" + n.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for n in ns)
    parts = [f"CASE WHEN {any_(ns)} THEN ['{t}'] ELSE []::VARCHAR[] END" for t, ns in D.NEEDLES.items()]
    parts += [f"CASE WHEN regexp_matches(x, '{p}') THEN {_list(t)} ELSE []::VARCHAR[] END" for p, t in D.PATTERNS]
    return f"array_to_string(list_sort(list_distinct({' || '.join(parts)})), ',')"


@query("semantic_tags", f"SELECT doc_id, {_tags_sql('x')} AS tags FROM (SELECT doc_id, lower(text) AS x FROM documents)")
def semantic_tags(spark: SparkSession, d: str) -> DataFrame:
    low = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.array_join(D.semantic_tags("low"), ",").alias("tags"))


@query("module_words", "SELECT url, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM (SELECT url, regexp_extract_all(lower(regexp_replace(url, '([0-9a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+') AS l FROM pages)")
def module_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", D.module_words("url").alias("words"))


@query("language_detect", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' ELSE 'unknown' END AS language FROM part")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.concat(F.col("p_name"), F.when(k == 0, ".py").when(k == 1, ".TSX").when(k == 2, ".a.rs").otherwise(".txt"))
    return table(spark, d, "part").select("p_partkey", language_of_path(path).alias("language"))




def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a table: without some rows, and with others changed."""
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "source", "doc_id")
    now = c.filter("source <> 'src7'")
    old = c.filter("source <> 'src4'").withColumn("content", F.when(F.col("source") == "src2", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return old.select("id", "content", "source"), now.select("id", "content", "source")


_TWO = """WITH c AS (SELECT doc_id::VARCHAR AS id, text AS content, source FROM documents), now AS (SELECT * FROM c WHERE source <> 'src7'),
old AS (SELECT id, CASE WHEN source = 'src2' THEN content || '!' ELSE content END AS content, source FROM c WHERE source <> 'src4')"""


@query("file_changes", _TWO + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old o FULL JOIN now n ON o.id = n.id WHERE o.content IS DISTINCT FROM n.content")
def file_changes(spark: SparkSession, d: str) -> DataFrame:
    old, now = _old_new(spark, d)
    return store.changed(old, now, "id")


@query("stale_files", _TWO + " SELECT DISTINCT source FROM old WHERE source NOT IN (SELECT source FROM now)")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    old, now = _old_new(spark, d)
    return store.stale(old, now, "source")


@query("merge_chunks", _TWO + ", n AS (SELECT * FROM now WHERE source IN ('src2', 'src4')) SELECT source, count(*)::BIGINT AS chunks, sum(length(content))::BIGINT AS chars FROM (SELECT * FROM old WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) GROUP BY source")
def merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    old, now = _old_new(spark, d)
    merged = store.upsert(old, now.filter("source IN ('src2', 'src4')"), ["id"])
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("delete_by_file", "SELECT source, count(*)::BIGINT AS chunks FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", "source")
    gone = c.filter("source IN ('src1', 'src2')")
    return store.delete(c, gone, "source").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "embed_work_items",
    _TWO + """, cache AS (SELECT id AS chunk_id, sha256(content) AS h, sha256('doc ' || content) AS g FROM old WHERE source <> 'src5')
SELECT n.id AS chunk_id, (c.h IS NULL OR c.h <> sha256(n.content)) AS needs_code, (c.g IS NULL OR c.g <> sha256('doc ' || n.content)) AS needs_doc FROM now n LEFT JOIN cache c ON c.chunk_id = n.id
WHERE c.h IS NULL OR c.h <> sha256(n.content) OR c.g <> sha256('doc ' || n.content)""",
)
def embed_work_items(spark: SparkSession, d: str) -> DataFrame:
    old, now = _old_new(spark, d)
    docs = lambda x: x.select(F.col("id").alias("chunk_id"), F.concat(F.lit("doc "), "content").alias("search_text"))
    empty = spark.createDataFrame([], "chunk_id string, content_hash string, search_doc_hash string, vector_dtype string, updated_at timestamp")
    known = old.filter("source <> 'src5'")
    return store.embedding_work(now, docs(now), store.mark_cache(empty, known, docs(known)))


@query(
    "cache_ttl",
    """WITH e AS (SELECT 'k' || doc_id AS key, (1 + doc_id % 3)::INT AS level, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 86400 ELSE 300 END AS ttl FROM documents)
SELECT level, count(*)::BIGINT AS entries FROM e WHERE ttl = 0 OR 1000 + ttl > 1000 + 300 GROUP BY level""",
)
def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.concat(F.lit("k"), "doc_id").alias("key"), (1 + F.col("doc_id") % 3).cast("int").alias("level"), F.lit("{}").alias("value"), F.lit(None).cast("string").alias("file_hash"))
    cache = store.cache_put(spark.createDataFrame([], store.CACHE), rows, 1000.0)
    return store.cache_stats(store.cache_live(cache, 1300.0))


@query("index_stats", "SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("documents", "embeddings", "pages"):
        part = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(table(spark, d, "documents").agg(F.countDistinct("source").alias("n")).select(F.lit("sources").alias("name"), "n"))


@query("indexed_files", "SELECT DISTINCT source FROM documents ORDER BY source")
def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


@query("chunk_by_file", "SELECT source, arg_min(doc_id, doc_id)::BIGINT AS doc_id FROM documents GROUP BY source")
def chunk_by_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", "doc_id").alias("doc_id"))


@query(
    "symbol_chunk_fallback",
    """WITH q AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1), p AS (SELECT p_partkey, p_name, p_size FROM part),
h AS (SELECT q.l_orderkey, p.p_partkey, CASE WHEN p.p_partkey = q.l_partkey THEN 0 ELSE 1 END AS prio FROM q JOIN p ON p.p_partkey = q.l_partkey OR p.p_partkey = q.l_suppkey)
SELECT l_orderkey, arg_min(p_partkey, (prio, p_partkey))::BIGINT AS chosen FROM h GROUP BY l_orderkey""",
)
def symbol_chunk_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The exact match if there is one, else the next kind: equi-joins stacked with a priority, the least wins."""
    q = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey")
    keys = q.select("l_orderkey", F.explode(F.array(F.struct(F.lit(0).alias("prio"), F.col("l_partkey").alias("k")), F.struct(F.lit(1).alias("prio"), F.col("l_suppkey").alias("k")))).alias("s")).select("l_orderkey", "s.prio", "s.k")
    hit = keys.join(table(spark, d, "part").select("p_partkey"), F.col("k") == F.col("p_partkey"))
    return hit.groupBy("l_orderkey").agg(F.min_by("p_partkey", F.struct("prio", "p_partkey")).alias("chosen"))


#: Suppliers as symbols of their nation's file, parts' names as chunks.
_LOOKUP_SQL = """
s AS (SELECT n_name || '.' || s_name AS qualified_name, s_name AS name, n_name AS file_path FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT 'c' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'other' ELSE s_name END AS symbol_name, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS parent_symbol, CASE WHEN s_suppkey % 5 = 0 THEN 'moved' ELSE n_name END AS file_path, s_suppkey AS start_line FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT qualified_name AS q, file_path AS f, split_part(qualified_name, '.', -1) AS n, split_part(qualified_name, '.', -2) AS p FROM s),
h AS (SELECT q AS name, id, CASE WHEN c.file_path = f AND parent_symbol IS NOT DISTINCT FROM p THEN 0 WHEN c.file_path = f THEN 1 ELSE 2 END AS prio, c.file_path, start_line FROM w JOIN c ON symbol_name = n
  UNION ALL SELECT q, id, 3, c.file_path, start_line FROM w JOIN c ON c.file_path = f)
SELECT name, arg_min(id, (prio, file_path, start_line, id)) AS id, min(prio)::INT AS prio FROM h GROUP BY name"""


@query("qualified_lookup", "WITH " + _LOOKUP_SQL)
def qualified_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol's chunk: in its class and file, in its file, of its name anywhere, else its file's first."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: a fixed table
    symbols = s.select(F.concat_ws(".", "n_name", "s_name").alias("qualified_name"), F.col("s_name").alias("name"), F.col("n_name").alias("file_path"))
    k = F.col("s_suppkey")
    chunks = s.select(F.concat(F.lit("c"), k).alias("id"), F.when(k % 3 == 0, "other").otherwise(F.col("s_name")).alias("symbol_name"), F.when(k % 2 == 0, F.col("n_name")).alias("parent_symbol"), F.when(k % 5 == 0, "moved").otherwise(F.col("n_name")).alias("file_path"), k.alias("start_line"))
    return lookup.chunks_by_qualified(symbols.select(F.col("qualified_name").alias("name")), chunks, symbols)


_NAMED = "(SELECT 'p' || p_partkey AS qualified_name, p_name AS name, p_brand || ' ' || p_type AS signature, p_brand AS file_path, p_type AS symbol_type FROM part)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("qualified_name"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("signature"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("symbol_type"))


@query("symbols_by_name", f"SELECT * FROM ({bm25_sql('red bolt', _NAMED, 'qualified_name, name, file_path, symbol_type', ['name', 'signature'], 'qualified_name', 10**9, False)}) ORDER BY (name = 'red bolt') DESC, score DESC, qualified_name LIMIT 5")
def symbols_by_name(spark: SparkSession, d: str) -> DataFrame:
    return lookup.symbols_by_name(_named(spark, d), "red bolt", 5)


@query("symbols_fts", bm25_sql("red bolt", _NAMED, "qualified_name, name, file_path, symbol_type", ["name", "qualified_name", "signature", "file_path"], "qualified_name", 5, False))
def symbols_fts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.symbols_fts(_named(spark, d), "red bolt", 5)


@query(
    "embedding_status",
    _TWO + """, cache AS (SELECT id AS chunk_id, sha256(content) AS h, sha256('doc ' || content) AS g FROM old WHERE source <> 'src5')
SELECT n.id AS chunk_id, coalesce(c.h = sha256(n.content), false) AND n.source <> 'src3' AS code_current, coalesce(c.g = sha256('doc ' || n.content), false) AND n.source <> 'src6' AS doc_current FROM now n LEFT JOIN cache c ON c.chunk_id = n.id""",
)
def embedding_status(spark: SparkSession, d: str) -> DataFrame:
    old, now = _old_new(spark, d)
    docs = lambda x: x.select(F.col("id").alias("chunk_id"), F.concat(F.lit("doc "), "content").alias("search_text"))
    known = old.filter("source <> 'src5'")
    cache = store.mark_cache(spark.createDataFrame([], store.EMBEDDING_CACHE), known, docs(known))
    vectors = lambda gone: now.filter(F.col("source") != gone).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"))
    return store.embedding_status(now, docs(now), cache, vectors("src3"), vectors("src6"))


_LISTED = r"import\s*\([^)]*\)"
_IMPORT = r"(?:import|from|use|extern crate|mod|require|#include|package|export\b[^\n]*\bfrom|(?:const|let|var)\b[^\n=]*=\s*require)\b[^\n]*"


@query("import_lines", rf"SELECT doc_id, regexp_replace(array_to_string(regexp_extract_all(coalesce(text, ''), '(?m)^[ \t]*({_LISTED}|{_IMPORT})', 1)[1:12], ' '), '\s+', ' ', 'g') AS imports FROM documents")
def import_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.import_lines("text").alias("imports"))


def _words_sql(c: str) -> str:
    short = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.STANDS_FOR.items())
    keys = ", ".join(f"'{k}'" for k in D.STANDS_FOR)
    return rf"""array_to_string(list_filter([array_to_string(regexp_extract_all(lower(regexp_replace({c}, '([0-9a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+|[0-9]+'), ' '),
array_to_string(list_transform(list_filter([{keys}], lambda k: regexp_matches(lower({c}), '(^|[^a-z])' || k)), lambda k: CASE k {short} END), ' ')], lambda x: x <> ''), ' ')"""


@query("identifier_words", f"SELECT p_partkey, {_words_sql('n')} AS words FROM (SELECT p_partkey, p_brand || p_type || 'ReqCtx_fp16' || p_size AS n FROM part)")
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_brand", "p_type", F.lit("ReqCtx_fp16"), "p_size")
    return table(spark, d, "part").select("p_partkey", D.identifier_words(name).alias("words"))


_RETURNS = r"""yields values one by one=\byield\b
returns true or false=\breturn\s+(true|false)\b
returns nothing=\breturn\s+(none|null|nil)\b
returns a mapping=\breturn\s+(\{|dict\()
returns a sequence=\breturn\s+(\[|\(|list\(|tuple\()
returns text=\breturn\s+(str\(|f?["''])
returns parsed json=\bjson\.loads?\b
returns a value=\breturn\s+\S"""


@query("return_summary", "SELECT doc_id, CASE " + " ".join("WHEN regexp_matches(t, '{1}') THEN '{0}'".format(*x.split("=", 1)) for x in _RETURNS.splitlines()) + " ELSE '' END AS said FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def return_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.return_summary("text", F.lit(None).cast("string")).alias("said"))


@query(
    "clean_summary",
    rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: regexp_replace(x, '^[\s"''*/#]+|[\s"''*/#]+$', '', 'g')), lambda x: regexp_matches(x, '[^-:*=_ ]') AND NOT list_contains({_list(D.SECTION_HEADS)}, lower(regexp_replace(x, ':+$', '')))) AS l FROM documents),
w AS (SELECT doc_id, trim(regexp_replace(array_to_string(l, ' '), '\s+', ' ', 'g'), ' ') AS w FROM l)
SELECT doc_id, CASE WHEN length(w) <= 260 THEN w WHEN contains(w[1:260], ' ') THEN regexp_replace(w[1:260], ' [^ ]*$', '') ELSE w[1:260] END AS summary FROM w""",
)
def clean_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.clean_summary(F.col("text")).alias("summary"))


@query("file_globs", "SELECT p_partkey, p_name || '.x' GLOB '*.x' AS hit FROM part")
def file_globs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", path_like(F.concat("p_name", F.lit(".x")), file_glob(active_file="src/main.x")).alias("hit"))


@query("token_budget", "SELECT * FROM (VALUES ('definition', 27000::BIGINT), ('relations', 27000), ('dependency', 21600), ('dataflow', 16200), ('community', 16200)) t(section, tokens)")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(C.Budget().allocate().items()), "section string, tokens long")


@query("budget_fit", "SELECT doc_id, left_before FROM (SELECT doc_id, 5000 - coalesce(sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_before FROM documents) WHERE left_before > 0")
def budget_fit(spark: SparkSession, d: str) -> DataFrame:
    """The shortest documents that fit in a budget."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return C.fit(rows, "n_chars", 5000, ["n_chars", "doc_id"]).select("doc_id", "left_before")


_SECTION = "(SELECT '{1} (' || count(*) || '):' || chr(10) || string_agg('- ' || node, chr(10) ORDER BY depth, node) FROM (SELECT * FROM both_ WHERE depth > 0 AND direction = '{0}' ORDER BY depth, node LIMIT 10) HAVING count(*) > 0)"


@query("impact_context", IMPACT_SQL + f"SELECT '{START}' AS symbol, concat_ws(chr(10) || chr(10), '# Impact of {START}', {_SECTION.format('upstream', 'Upstream')}, {_SECTION.format('downstream', 'Downstream')}) AS context")
def impact_context(spark: SparkSession, d: str) -> DataFrame:
    return C.impact_context(links(spark, d), START)


@query("structured_context")
def structured_context(spark: SparkSession, d: str) -> DataFrame:
    _, s, calls = parsed(spark)
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return C.structured_context("app.reader.read_json", s, edges, FL.flows(files(spark), s))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


