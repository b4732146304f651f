"""The engine as one object: build an index over a folder, keep it up to date, search it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import documents as D
from sparkloom.functions.text import language_family, language_is, language_of_path, normal_language, path_like, tags_all, tags_any
from sparkloom.operators import context as C
from sparkloom.operators import dataflow as FL
from sparkloom.operators import fusion as R
from sparkloom.operators import graph as G
from sparkloom.operators import rerank as RR
from sparkloom.operators import routing as RT
from sparkloom.operators.bm25 import bm25
from sparkloom.operators.knn import knn_one, quantise
from sparkloom.sources import parse, store
from sparkloom.sources.cache import Cache
from sparkloom.sources.embedding import PART, HashingProvider, Provider, embed
from sparkloom.sources.tables import cut


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    rrf_k: int = 60
    nl_rrf_k: int = 0
    rerank_top_k: int = 10
    context_rrf_boost: float = 0.003
    context_rerank_boost: float = 0.03
    max_symbols: int = 12
    max_symbol_rows: int = 5
    max_neighbors: int = 12
    prefilter: bool = True
    rerank_mode: str = "redetect"
    reranker: str = "v1"
    vector_type: str = "float32"
    community_method: str = "modularity"
    weights: dict[str, float] | None = None
    libraries: frozenset[str] = field(default_factory=lambda: frozenset(RR.LIBRARIES))

    def stable_hash(self) -> str:
        plain = {k: sorted(v) if isinstance(v, frozenset) else v for k, v in asdict(self).items()}
        return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]


Counts = dict[str, int]
Text = str | None
Tags = list[str] | None
RESULT = ["id", "symbol_name", "qualified_name", "file_path", "line_number", "chunk_type", "score", "snippet", "signature", "docstring", "tags", "channel_ranks", "language"]


class Engine:
    """``Engine(spark, workspace, index_dir)``; searches return DataFrames."""

    def __init__(self, spark: SparkSession, workspace: str, index_dir: str, config: Config | None = None, provider: Provider | None = None, auto_index: bool = True, cache: Cache | None = None, embedding_text: Callable[[str], Column] | None = None):
        """``cache`` keeps contexts; ``embedding_text`` says what of a search document is embedded (default: ``functions.documents.embedding_text``)."""
        self.spark, self.workspace, self.config = spark, workspace.rstrip("/"), config or Config()
        self.index_store, self.provider = store.Index(spark, index_dir), provider or HashingProvider()
        self.cache, self._embedding_text = cache, embedding_text or D.embedding_text
        if self.index_store.version():
            for name in ("code_vectors", "doc_vectors"):
                store.check_vector_type(self.index_store.read(name), self.config.vector_type)
        if auto_index and not self.index_store.version():
            self.index()

    # -- building ------------------------------------------------------------------

    def _derive(self, files: DataFrame, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The index tables of these files.  Vectors of ``known`` tables are kept where the hash of what was embedded is the same."""
        chunks, symbols, calls = map(cut, parse.parse_files(files))
        docs = cut(D.search_documents(chunks, symbols))
        keyed = store.last_write(symbols, ["qualified_name"], [F.col("file_path"), F.col("line_number")])
        said = docs.select("chunk_id", self._embedding_text("search_text").alias("search_text"))
        cache = known["embedding_cache"] if known else self.spark.createDataFrame([], store.EMBEDDING_CACHE)
        work = cut(store.embedding_work(chunks, said, cache, self.config.vector_type))
        vectors = {}
        for name, need, rows, text, limit in (("code_vectors", "needs_code", chunks.select(F.col("id").alias("chunk_id"), F.col("content").alias("t")), "t", 2048), ("doc_vectors", "needs_doc", said.withColumnRenamed("search_text", "t"), "t", 1024)):
            kept = known[name].filter("embedding IS NOT NULL").join(rows.select("chunk_id"), "chunk_id", "left_semi") if known else None
            # a chunk without a vector is embedded whatever the cache says
            asked = work.filter(need).select("chunk_id")
            if kept is not None:
                kept = cut(kept.join(asked, "chunk_id", "left_anti"))
                asked = rows.select("chunk_id").join(kept, "chunk_id", "left_anti")
            new = self._vectors(embed(rows.join(asked, "chunk_id", "left_semi"), "chunk_id", text, self.provider, limit=limit))
            vectors[name] = cut(kept.unionByName(new) if kept is not None else new)
        whole = vectors["code_vectors"].filter("embedding IS NOT NULL").join(vectors["doc_vectors"].filter("embedding IS NOT NULL"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"))
        marked = store.mark_cache(self.spark.createDataFrame([], store.EMBEDDING_CACHE), chunks.join(whole, "id", "left_semi"), said, self.config.vector_type)
        return {"files": files.select("path", "content"), "chunks": chunks, "symbols": keyed, "calls": calls, "search_docs": docs, **vectors, "embedding_cache": marked}

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("embedding", quantise(F.col("embedding"))) if self.config.vector_type == "int8" else rows.withColumn("embedding", F.col("embedding").cast("array<float>"))

    def index(self) -> Counts:
        """A full build."""
        self.index_store.write(self._derive(store.scan(self.spark, self.workspace).select("path", "content")))
        return self.stats()

    def refresh(self) -> DataFrame:
        """Bring the index up to date with the folder; only new and modified files are parsed and embedded.  Returns path, change."""
        now = store.scan(self.spark, self.workspace).select("path", "content")
        changes = store.changed(self.index_store.read("files"), now)
        rows = cut(changes)
        if not rows.isEmpty():
            self._apply(now.join(rows.filter("change <> 'deleted'").select("path"), "path", "left_semi"), rows)
        return rows

    def reindex_file(self, path: str) -> DataFrame:
        """One file, by its path below the workspace; a missing file is deleted from the index."""
        now = store.scan(self.spark, self.workspace).select("path", "content").filter(F.col("path") == path)
        changes = store.changed(self.index_store.read("files").filter(F.col("path") == path), now)
        rows = cut(changes)
        if not rows.isEmpty():
            self._apply(now, rows)
        return rows

    def _apply(self, fresh: DataFrame, changes: DataFrame) -> None:
        gone = changes.select("path")
        touched = [r[0] for r in gone.select(store.bucket(F.col("path"))).distinct().collect()]  # at most as many as there are parts
        read = lambda name: self.index_store.read(name, touched)
        old_ids = cut(read("chunks").join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("id").alias("chunk_id")))
        known = {n: read(n).join(old_ids, "chunk_id", "left_semi") for n in ("code_vectors", "doc_vectors", "embedding_cache")}
        new = self._derive(fresh, known)
        by_file = lambda name, c: read(name).join(gone.withColumnRenamed("path", c), c, "left_anti")
        calls = read("calls").withColumn("_p", F.regexp_replace("call_site", r":\d+$", "")).join(gone.withColumnRenamed("path", "_p"), "_p", "left_anti").drop("_p")
        kept = {"files": by_file("files", "path"), "chunks": by_file("chunks", "file_path"), "symbols": by_file("symbols", "file_path"), "calls": calls}
        kept |= {n: store.delete(read(n), old_ids, "chunk_id") for n in ("search_docs", "code_vectors", "doc_vectors", "embedding_cache")}
        self.index_store.write({n: kept[n].select(*new[n].columns).unionByName(new[n]) for n in kept}, touched)

    def stats(self) -> Counts:
        return self.index_store.stats()

    def embedding_status(self) -> DataFrame:
        """chunk_id, code_current, doc_current."""
        read = self.index_store.read
        said = read("search_docs").select("chunk_id", self._embedding_text("search_text").alias("search_text"))
        return store.embedding_status(read("chunks"), said, read("embedding_cache"), read("code_vectors"), read("doc_vectors"), self.config.vector_type)

    def embed_missing(self) -> DataFrame:
        """Embeds again what has no vector, as after failures of the provider.  Returns embedding_status."""
        read = self.index_store.read
        lost = self.embedding_status().filter("NOT (code_current AND doc_current)").select(F.col("chunk_id").alias("id"))
        files = cut(read("chunks").join(lost, "id", "left_semi").select(F.col("file_path").alias("path")).distinct())
        if not files.isEmpty():
            self._apply(cut(read("files").join(files, "path", "left_semi").select("path", "content")), files)
        return self.embedding_status()

    def edges(self) -> DataFrame:
        """Calls as (src, dst).  Names that a file couldn't resolve by itself are looked up among all symbols; others stay external."""
        calls = self.index_store.read("calls").select(F.col("caller").alias("src"), F.col("callee").alias("name")).distinct()
        known = G.resolve_names(calls, self.index_store.read("symbols").select(F.col("qualified_name").alias("node")))
        return calls.join(known, "name", "left").select("src", F.coalesce("resolved", "name").alias("dst")).distinct()

    # -- searching -----------------------------------------------------------------

    def _route(self, query: str) -> tuple[str, str, dict[str, float], str]:
        row = RT.route(self.spark.createDataFrame([(query,)], "query string")).first()
        return row["query_type"], row["profile"], self.config.weights or row["weights"].asDict(), row["expanded"]

    def _graph(self, query: str, k: int) -> DataFrame:
        """Chunks of symbols that the query names, and of their callers and callees."""
        c, names = self.config, RT.symbol_candidates(query, set(self.config.libraries), self.config.max_symbols)
        symbols, chunks = self.index_store.read("symbols"), self.index_store.read("chunks")
        parts = [(n.strip("_*").lower(), n.endswith("*")) for n in names if len(n.strip("_*")) >= 2]
        shape = "name string, part boolean"
        wanted = F.broadcast(self.spark.createDataFrame(parts or [("\0", False)], shape))  # at most max_symbols rows
        low = F.lower(F.col("s.name"))
        hit = symbols.alias("s").join(wanted.alias("w"), F.contains(low, F.col("w.name")))
        tier = F.when(low == F.col("w.name"), 1.0).when(F.col("w.part"), 0.45).otherwise(0.65)
        top = Window.partitionBy("w.name", "w.part").orderBy(F.desc("base"), "s.qualified_name")
        found = hit.withColumn("base", tier).withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= c.max_symbol_rows)
        found = found.groupBy(F.col("s.qualified_name").alias("q")).agg(F.max("base").alias("score"))
        e = self.edges()
        strong = found.filter("score >= 0.65")
        near = []
        for a, b, share in (("dst", "src", 0.30), ("src", "dst", 0.25)):
            w = Window.partitionBy("q").orderBy(b)
            near.append(e.join(strong, e[a] == strong["q"]).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= c.max_neighbors).select(F.col(b).alias("q"), (F.col("score") * share).alias("score")))
        all_ = found.unionByName(near[0]).unionByName(near[1]).groupBy("q").agg(F.max("score").alias("score"))
        s = all_.join(symbols.select(F.col("qualified_name").alias("q"), F.col("name").alias("_n"), F.col("file_path").alias("_f")), "q")
        kind = F.when((F.col("symbol_name") == F.col("_n")) & (F.col("file_path") == F.col("_f")), 0).when(F.col("symbol_name") == F.col("_n"), 1).otherwise(2)
        near_chunk = chunks.join(s, (chunks["symbol_name"] == s["_n"])).select("id", "q", "score", kind.alias("k"), "file_path", "start_line")
        best = near_chunk.groupBy("q").agg(F.min_by(F.struct("id", "score"), F.struct("k", "file_path", "start_line", "id")).alias("b"))
        out = best.select("b.id", "b.score", F.col("q").alias("qualified_name")).groupBy("id").agg(F.max("score").alias("score"), F.min("qualified_name").alias("qualified_name"))
        return out.orderBy(F.desc("score"), "id").limit(k)

    def search(self, query: str, language: Text = None, top_k: int | None = None, tags: Tags = None, file_pattern: Text = None, context: dict[str, str] | None = None, explain: bool = False) -> DataFrame:
        """The best chunks.  ``context``: active_file, language, repo, workspace; a soft preference, or (without allow_cross_language) a filter on the language."""
        c, k, ctx = self.config, top_k or self.config.top_k, context or {}
        qtype, _, w, expanded = self._route(query)
        text = expanded if qtype == "nl" else query
        wanted = normal_language(ctx.get("language")) or (self._path_language(ctx["active_file"]) if ctx.get("active_file") else "")
        if wanted and language is None and str(ctx.get("allow_cross_language", "")).lower() in ("", "false"):
            language = wanted
        chunks = self.index_store.read("chunks")
        keep = path_like("file_path", file_pattern) & language_is("language", language)
        keep_all, keep_any = keep & tags_all("tags", tags or []), keep & tags_any("tags", tags or [])
        rows = chunks.withColumn("tag_text", F.to_json("tags"))
        lexical = bm25(rows, text, "id", ["content", "symbol_name", "docstring", "tag_text"], 3 * k, qtype == "nl", keep_all).select("id", "score")
        vec = self.index_store.read("doc_vectors" if qtype == "nl" else "code_vectors").withColumnRenamed("chunk_id", "id").filter("embedding IS NOT NULL")
        if qtype == "nl" and vec.isEmpty():  # no search document was embedded: the code's vectors answer
            vec = self.index_store.read("code_vectors").withColumnRenamed("chunk_id", "id").filter("embedding IS NOT NULL")
        pool = vec.join(chunks.filter(keep_any).select("id"), "id", "left_semi") if c.prefilter else vec
        asked = self._vector_of(text)
        near = knn_one(pool, asked, "id", "embedding", 3 * k).select("id", "score") if asked else pool.select("id", F.lit(0.0).alias("score")).limit(0)
        graph = cut(self._graph(query, 2 * k))
        allowed = chunks.filter(keep_any).select("id")
        order = [F.desc("score"), F.col("id")]
        channels = {"bm25": R.ranked(lexical, order), "vector": R.ranked(near.join(allowed, "id", "left_semi"), order), "graph": R.ranked(graph.join(allowed, "id", "left_semi"), order)}
        fused = R.fuse(channels, w, "id", (c.nl_rrf_k or c.rrf_k) if qtype == "nl" else c.rrf_k)
        tokens = sorted({t for key in ("active_file", "workspace", "path", "module", "package") for t in _words(ctx.get(key, ""))})
        full = fused.join(chunks, "id").join(graph.select("id", "qualified_name"), "id", "left").join(self.index_store.read("search_docs").withColumnRenamed("chunk_id", "id").withColumnRenamed("search_text", "search_document"), "id", "left")
        full = full.withColumn("summary", D.summary_text("search_document")).withColumn("owner_text", D.owner_text("search_document"))
        match = R.context_match(F.col("language"), F.col("file_path"), language_family(wanted), ctx.get("repo"), tokens)
        full = R.boost(full, match, c.context_rrf_boost if ctx else 0.0)
        full = cut(full.orderBy(*R.stable_order("score", "file_path", "start_line", "symbol_name", "id")).limit(k))  # k rows, read twice below
        cand = self._with_symbols(full)
        again = text if c.rerank_mode == "redetect" else query
        nl = (self.spark.createDataFrame([(again,)], "q string").select(RT.query_type("q")).first()[0] if c.rerank_mode == "redetect" else qtype) == "nl"
        if c.reranker == "v2":
            ranked = RR.rerank_v2(cand, again).orderBy(F.desc("rerank_score"), "id").limit(min(c.rerank_top_k, k)).withColumn("stage", F.lit("rerank"))
            explain = False
        else:
            ranked = RR.rerank(cand, again, nl, min(c.rerank_top_k, k))
        out = ranked.select("id", "symbol_name", "qualified_name", "file_path", F.col("start_line").alias("line_number"), "chunk_type", F.col("rerank_score").alias("score"), F.substring("content", 1, 500).alias("snippet"), "signature", "docstring", "tags", "channel_ranks", "language", *((*RR.FEATURES, "stage") if explain else ()))
        return out.orderBy(*R.stable_order("score", "file_path", "line_number", "symbol_name", "id"))

    def _vector_of(self, query: str) -> list[float]:
        """The query's vector; empty where the provider fails, so that the other channels answer."""
        try:
            return self.provider.embed([query])[0].tolist()
        except Exception:  # noqa: BLE001 - a provider may fail in any way
            return []

    def _with_symbols(self, rows: DataFrame) -> DataFrame:
        """Candidates with what is known of their symbol: that of their name in their file, else their file's first one."""
        s = self.index_store.read("symbols").join(F.broadcast(rows.select("file_path").distinct()), "file_path", "left_semi")
        text = F.array_join(F.transform("parameters", lambda p: F.concat_ws(" ", p["name"], p["type_annotation"])), " ")
        known = F.struct("signature", "return_type", "decorators", F.size("parameters").alias("n_params"), text.alias("param_text"), "symbol_type")
        first = s.groupBy("file_path").agg(F.min_by(known, F.struct("line_number", "qualified_name")).alias("_file"))
        named = s.groupBy("file_path", F.col("name").alias("symbol_name")).agg(F.min_by(known, F.struct("line_number", "qualified_name")).alias("_own"))
        both = rows.join(F.broadcast(named), ["symbol_name", "file_path"], "left").join(F.broadcast(first), "file_path", "left")
        return both.withColumn("_s", F.coalesce("_own", "_file")).select("*", "_s.*").drop("_s", "_own", "_file")

    def search_document(self, chunk_id: str) -> str | None:
        row = self.index_store.read("search_docs").filter(F.col("chunk_id") == chunk_id).first()
        return row["search_text"] if row else None

    def search_explain(self, query: str, **options) -> tuple[dict, DataFrame]:
        """(trace, results with the features that made their scores)."""
        qtype, profile, w, expanded = self._route(query)
        trace = {"query": query, "query_type": qtype, "query_profile": profile, "route": profile, "weights": w, "expanded_query": expanded, "config_hash": self.config.stable_hash(), "index_snapshot_id": self.index_store.snapshot_id(), "embedding_provider": type(self.provider).__name__, "embedding_dimension": self.provider.dimension, "context_routing_mode": "soft" if options.get("context") else "none"}
        return trace, self.search(query, explain=True, **options)

    def _path_language(self, path: str) -> str:
        found = self.spark.createDataFrame([(path,)], "p string").select(language_of_path("p")).first()[0]
        return "" if found == "unknown" else found

    # -- the graph -------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        """node, symbol_type, file_path, line_number, signature, return_type: all symbols, and as ``external`` what is only called."""
        s = self.index_store.read("symbols").select(F.col("qualified_name").alias("node"), "symbol_type", "file_path", "line_number", "signature", "return_type")
        outside = G.nodes_of(self.edges()).join(s.select("node"), "node", "left_anti").withColumn("symbol_type", F.lit("external"))
        return s.unionByName(outside, allowMissingColumns=True)

    def _start(self, symbol: str) -> DataFrame:
        """A symbol's node; of a name that is none, the nodes that end in it, else contain it."""
        nodes = self.nodes().select("node")
        return F.broadcast(cut(nodes.filter(F.col("node") == symbol))) if not nodes.filter(F.col("node") == symbol).isEmpty() else F.broadcast(cut(G.fuzzy(nodes, symbol)))

    def _enrich(self, found: DataFrame) -> DataFrame:
        """With file, line and kind where they are known; others are external, at half the score."""
        out = found.join(self.nodes(), "node", "left").withColumn("symbol_type", F.coalesce("symbol_type", F.lit("external")))
        return out.withColumn("score", F.when(F.col("symbol_type") == "external", 0.5 / F.col("depth")).otherwise(1 / F.col("depth")))

    def _walk(self, symbol: str, depth: int, back: bool) -> DataFrame:
        e = cut(self.edges())
        found = G.k_hop(G.reverse(e) if back else e, self._start(symbol), depth)
        call = self.index_store.read("calls").groupBy("caller").agg(F.sort_array(F.collect_set("call_type")).alias("call_types")).withColumnRenamed("caller", "node")
        return self._enrich(found).join(call, "node", "left")

    def callers(self, symbol: str, *, depth: int = 1) -> DataFrame:
        """node, depth, where it is, score, and the kinds of calls that it makes."""
        return self._walk(symbol, depth, True)

    def callees(self, symbol: str, *, depth: int = 1) -> DataFrame:
        return self._walk(symbol, depth, False)

    def impact(self, symbol: str) -> DataFrame:
        """What a change reaches, with file and line where they are known."""
        return self._enrich(G.impact(self.edges(), symbol))

    def flows(self) -> DataFrame:
        """The data flow edges of the indexed Python files."""
        return FL.flows(self.index_store.read("files"), self.index_store.read("symbols"))

    def trace_source(self, sink: str) -> DataFrame:
        return FL.trace_source(self.flows(), sink)

    def trace_sink(self, source: str) -> DataFrame:
        return FL.trace_sink(self.flows(), source)

    def unvalidated_in_impact(self, symbol: str) -> DataFrame:
        """source, sink, file_path of outside inputs without validation in the files that a change reaches."""
        files = self.impact(symbol).select("file_path").filter("file_path IS NOT NULL").distinct()
        return FL.unvalidated_inputs(self.flows()).join(files, "file_path", "left_semi").select("source", "sink", "file_path")

    def layers(self, merged: bool = True) -> DataFrame:
        """node, component, layer; small layers are merged with the next."""
        found = cut(G.layers(self.edges()))
        return G.merge_small_layers(found) if merged else found

    def layer_info(self) -> DataFrame:
        return G.layer_info(self.layers())

    def node_layer(self, node: str) -> int | None:
        row = G.layer_of(self.layers(), node).first()
        return row["layer"] if row else None

    def circular_dependencies(self, longest: int = 6) -> DataFrame:
        return G.cycles(self.edges(), longest)

    def communities(self) -> DataFrame:
        return G.communities(self.edges(), self.nodes().select("node"), self.config.community_method)

    def search_with_scope(self, symbol: str, purpose: str = "implementation", top_k: int = 10) -> DataFrame:
        """Nodes in the layers that a purpose looks at, nearest and most related first; without any layer, what BM25 finds."""
        found = self.layers()
        if found.isEmpty():
            chunks = self.index_store.read("chunks").withColumn("tag_text", F.to_json("tags"))
            hit = bm25(chunks, symbol, "id", ["content", "symbol_name", "docstring", "tag_text"], top_k, keep=["file_path", "symbol_name"])
            return hit.select(F.col("symbol_name").alias("node"), F.lit(None).cast("long").alias("layer"), "score", F.lit(None).cast("string").alias("symbol_type"), "file_path", F.lit(None).cast("int").alias("line_number"))
        own = G.layer_of(found, symbol).first()
        node = own["node"] if own else symbol
        e = cut(self.edges())
        best = G.relevance(G.scope_nodes(found, node, purpose), e, node).orderBy(F.desc("score"), "node").limit(top_k)
        return best.join(self.nodes().select("node", "symbol_type", "file_path", "line_number"), "node", "left").orderBy(F.desc("score"), "node")

    def graph_stats(self) -> Counts:
        """Nodes, edges, flows, entries, isolated nodes, layers, communities, and the cache's entries if there is one."""
        e = cut(self.edges())
        kinds = {r["kind"]: r["n"] for r in G.degree_classes(e, self.nodes().select("node")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = {"nodes": sum(kinds.values()), "edges": e.count(), "flows": self.flows().count(), "entry_points": kinds.get("entry", 0), "isolated": kinds.get("isolated", 0), "leaves": kinds.get("leaf", 0)}
        out |= {"layers": self.layers().select("layer").distinct().count(), "communities": self.communities().select("community").distinct().count(), "dimension": self.provider.dimension}
        return out | ({"cache": sum(self.cache.stats().values())} if self.cache else {})

    # -- contexts for a language model ----------------------------------------------

    def context(self, symbol: str, purpose: str = "implementation", budget: C.Budget | None = None) -> str:
        """Definition, layers, calls, data flow and community of a symbol as text; kept in the cache, if there is one."""
        key = f"context:{symbol}:{purpose}"
        held = self.cache.get_kind("query", key) if self.cache else None
        if held is not None:
            return held
        found = cut(self.layers())
        own = G.layer_of(found, symbol).first()
        scope = G.scope_nodes(found, own["node"], purpose) if own else None
        rows = C.structured_context(symbol, self.index_store.read("symbols"), self.edges(), self.flows(), self.communities(), budget, scope).collect()
        parts = [r["text"] for r in rows if r["text"]]
        text = "\n\n* * *\n\n".join(parts) if parts else f"No such symbol: {symbol}"
        if self.cache:
            self.cache.set_kind("query", key, text)
        return text

    symbol_context = context

    def impact_context(self, symbol: str) -> str:
        return C.impact_context(self.edges(), symbol, self.nodes().select("node", "file_path")).first()["context"]

    def search_context(self, query: str, tokens: int = 4000, **options) -> str:
        """The results of a search as text, as many as ``tokens`` hold."""
        rows = self.search(query, **options)
        rank = F.row_number().over(Window.orderBy(*R.stable_order("score", "file_path", "line_number", "symbol_name", "id")))  # top_k rows
        return C.search_context(rows.withColumn("rank", rank).withColumnRenamed("snippet", "content"), tokens).first()["context"]

    def close(self) -> None:
        """Nothing is held between calls."""


def _words(text: str) -> list[str]:
    return [t for t in PART.findall(text.lower()) if len(t) >= 2]
