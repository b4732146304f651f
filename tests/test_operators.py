import math
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import text as X
from sparkloom.operators import bm25, context, fusion, graph, knn, rerank, routing
from sparkloom.operators import dataflow as flow
from sparkloom.sources import lookup, parse, sample, store
from sparkloom.streaming import watch

CHUNKS = [
    (1, "def read_json(path): return json.load(open(path))", "read_json", "read a json file", '["exported","documented"]'),
    (2, "def write_json(p,o): json.dump(o,open(p))", "write_json", None, '["exported"]'),
    (3, "def add(a,b): return a+b", "add", "sum json", "[]"),
    (4, "class Foo: pass", "Foo", None, '["exported"]'),
    (5, "x = 1", "<module>", None, "[]"),
    (6, "y = jsonify(2)", "<module>", None, "[]"),
]
FIELDS = ["content", "symbol_name", "docstring", "tags"]


@pytest.mark.parametrize(("q", "any_term", "want"), [("read_json", False, {1: 1.406225}), ("json read", True, {1: 1.692917, 2: 1e-6, 3: 1e-6}), ("json sum", False, {3: 1.222353})])
def test_bm25_golden(spark, q, any_term, want):
    docs = spark.createDataFrame(CHUNKS, "id int, content string, symbol_name string, docstring string, tags string")
    got = {r["id"]: r["score"] for r in bm25.bm25(docs, q, "id", FIELDS, or_semantics=any_term).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_bm25_repeats_and_accents(spark):
    docs = spark.createDataFrame([(1, "Déjà vu ab_ab_ab"), (2, "other text"), (3, "")], "id int, t string")
    one, two = (bm25.bm25(docs, q, "id", ["t"]).first()["score"] for q in ("deja", "deja deja"))
    assert abs(two - 2 * one) < 1e-5
    assert bm25.bm25(docs, "ab_ab", "id", ["t"]).count() == 1 and bm25.bm25(docs, "", "id", ["t"]).count() == 0
    assert bm25.bm25(docs.limit(0), "deja", "id", ["t"]).count() == 0


def test_weights_sum_to_one():
    for w in rerank.WEIGHTS.values():
        assert math.isclose(sum(w.values()), 1.0)
    assert context.Budget().available == 108_000 and sum(context.Budget().allocate().values()) == 108_000


def test_fusion(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    two = spark.createDataFrame([("b", 1)], "id string, rank int")
    got = {r["id"]: r for r in fusion.fuse({"bm25": one, "graph": two}, fusion.CODE_WEIGHTS, "id").collect()}
    assert math.isclose(got["a"]["score"], 0.05 / 61) and round(got["a"]["score"], 6) == 0.00082
    assert math.isclose(got["b"]["score"], 0.05 / 62 + 0.9 / 61) and got["b"]["channel_ranks"] == {"bm25": 2, "graph": 1}


def test_routing_goldens(spark):
    probes = {"def read_json(path):": "code", "read_json_file": "code", "1. **Purpose**: reads; expected errors": "function_memory", "Bug report: the app crashes with TypeError": "issue", "for each user find the login": "code"}
    df = routing.route(spark.createDataFrame([(p,) for p in probes], "query string"))
    for r in df.collect():
        assert r["profile"] == probes[r["query"]]
        assert r["weights"]["graph"] == (0.3 if r["profile"] == "issue" else 0.9)
    i = routing.route(spark.createDataFrame([("who calls parse_config",)], "query string")).first()["intent"]
    assert (i["intent"], i["entity"], i["confidence"]) == ("relation", "parse_config", 0.8)
    assert "read_json_files" in routing.nl_symbols("function to read json files") and "handle_sort" in routing.nl_symbols("sorting")
    assert len(routing.symbol_candidates("parse the json config for the http handler", set())) <= 12


def test_languages_and_globs(spark):
    assert X.language_family("tsx") == ("javascript", "typescript") and X.normal_language("golang") == "go"
    df = spark.createDataFrame([("a/b.py",), ("a/c.TS",), ("x",)], "p string")
    assert [r[0] for r in df.select(X.language_of_path("p")).collect()] == ["python", "typescript", "unknown"]
    assert [r[0] for r in df.filter(X.path_like("p", "*.py")).collect()] == ["a/b.py"]
    assert df.filter(X.path_like("p", "a/*")).count() == 2 and df.filter(X.path_like("p", "?")).count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_graph_against_brute_force(spark, pairs):
    e = spark.createDataFrame(pairs, "src long, dst long")
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    assert {r["node"]: r["component"] for r in graph.scc(e).collect()} == want
    level = {r["node"]: (r["component"], r["layer"]) for r in graph.layers(e).collect()}
    for a, b in pairs:
        assert level[a][0] == level[b][0] or level[a][1] > level[b][1]


def test_distributed_rounds_agree(spark):
    r = random.Random(4)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(20)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    assert sorted(map(tuple, graph.layers(e).collect())) == sorted(map(tuple, graph.layers(e, one_task=0).collect()))
    a = graph.label_propagation(e, 2)
    b = graph.label_propagation(e.repartition(7), 2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_layers_and_scopes(spark):
    e = spark.createDataFrame([("app.main", "svc.service"), ("svc.service", "db.model"), ("x.service", "db.model")], "src string, dst string")
    found = graph.layers(e)
    assert {r["node"]: r["layer"] for r in found.collect()} == {"db.model": 0, "svc.service": 1, "x.service": 1, "app.main": 2}
    assert {r["node"] for r in graph.scope_nodes(found, "svc.service", "implementation").collect()} == {"svc.service", "x.service", "db.model"}
    assert graph.scope_nodes(found, "nobody", "debugging").count() == 4
    assert {r["layer"]: r["layer_type"] for r in graph.layer_types(found).collect()} == {0: "data", 1: "service", 2: "entry"}
    merged = graph.merge_small_layers(found)
    assert {r["layer"] for r in merged.collect()} == {0, 1} or {r["layer"] for r in merged.collect()} == {0}


def test_knn(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)] + [(99, None)], "id long, v array<double>")
    q = spark.createDataFrame([(1, [3.2, 1.0]), (2, [28.9, 1.0])], "q long, e array<double>")
    got = knn.knn_batch(v, q, "id", "v", "q", "e", 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 3), (1, 4), (1, 2), (2, 29), (2, 28), (2, 27)]
    assert [r["id"] for r in knn.knn_one(v.filter("id < 99"), [3.2, 1.0], "id", "v", 2).collect()] == [3, 4]


def test_knn_many_queries(spark, monkeypatch):
    """What a task holds doesn't follow queries * rows; blocks of queries give what one gives."""
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 4)).round(1), rng.normal(size=(12_000, 4)).round(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(x))], ["id", "v"])
    for metric in knn.METRICS:
        tracemalloc.start()
        got = pa.Table.from_batches(knn._best(np.arange(12_000), q, 5, metric, "id", "v")(iter([batch]))).to_pandas()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6  # the scores alone are 288 MB
        for n in (0, 77, 11_999):
            own = {"l2": -np.sqrt(((x - q[n]) ** 2).sum(1)), "dot": x @ q[n], "cosine": x @ q[n] / np.sqrt((x**2).sum(1) * (q[n] ** 2).sum())}[metric].round(6)
            assert list(got.id[got.query_id == n]) == list(np.lexsort((np.arange(3000), -own))[:5])
    v = spark.createDataFrame([(k, [float(a) for a in x[k]]) for k in range(300)], "id long, v array<double>")
    one = knn.knn_batch(v, v, "id", "v", "id", "v", 3).collect()
    monkeypatch.setattr(knn, "QUERY_BYTES", 4000)
    assert sorted(knn.knn_batch(v, v, "id", "v", "id", "v", 3).collect()) == sorted(one)


def test_routing_reads_patterns_as_its_sql(spark, tmp_path):
    """Boundaries and classes are of ASCII, case is folded as RE2 does, whatever letters and spaces are around."""
    texts = ["test\u00e4 f\u00fcr", "\u00e4test", "te\u017ft", "\u017fort\u017f", "chec\u212a it", "multipl\u0130ication", "\u00a0who calls a\u3000", "who\x0bcalls b", "explain a\rb\u2028c", "\u0130ssue: a b c d e", "config\u00df"]
    spark.createDataFrame([(n, 0, "user", t) for n, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("query_expand", "route_intent", "route_type", "route_profile"):
        got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
        want = con.sql(registry.SQL[name]).df()
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None))


def test_lookup_of_many_names_in_one_file(spark):
    """Time follows the names and chunks, not their product (400 million here)."""
    k = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    symbols = k.select(F.concat(F.lit("f."), "k").alias("qualified_name"), F.lit("f").alias("file_path"))
    chunks = k.select(F.concat(F.lit("c"), "k").alias("id"), F.when(F.col("k").cast("int") % 2 == 0, F.col("k")).alias("symbol_name"), F.lit("f").alias("parent_symbol"), F.lit("f").alias("file_path"), (F.col("k").cast("int") % 7).alias("start_line"))
    began = time.monotonic()
    got = lookup.chunks_by_qualified(symbols.select(F.col("qualified_name").alias("name")), chunks, symbols).toPandas()
    assert time.monotonic() - began < 40
    want = {f"f.{n}": (f"c{n}", 0) if n % 2 == 0 else ("c0", 3) for n in range(20_000)}
    assert dict(zip(got["name"], zip(got["id"], got["prio"]))) == want


def test_flows_read_texts_once(spark, tmp_path):
    """Flows have the files' texts behind them: their plan reads what was found, not the texts again."""
    rows = [("a.py", "x = input()\nassert y\nx.validate()\n"), ("b.py", "import os\n y: str = os.environ['Y']\r\ny = escape(y)"), ("c.py", "nothing = 1"), ("d.txt", "x = input()"), ("e.py", None)]
    spark.createDataFrame(rows, "path string, content string").write.parquet(f"{tmp_path}/f")
    none = spark.createDataFrame([], "qualified_name string, file_path string, line_number int, return_type string, symbol_type string, parameters array<struct<name: string, type_annotation: string>>")
    found = flow.flows(spark.read.parquet(f"{tmp_path}/f"), none)
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["source"], r["sink"], r["line_number"], r["validation_level"], r["sanitized"]) for r in found.collect()}
    assert got == {("user_input", "a.py:x", 1, "full", False), ("env_vars", "b.py:y", 2, "none", True)}


def test_parser():
    chunks, symbols, calls = parse.parse_text("app/reader.py", sample.FILES["app/reader.py"])
    by = {c["symbol_name"]: c for c in chunks}
    assert {"<module>", "Reader", "Store", "read_json", "clean", "check"} == set(by)
    assert by["check"]["id"] == f"app/reader.py#check@{by['check']['start_line']}-{by['check']['end_line']}" and "documented" in by["Reader"]["tags"]
    s = {x["qualified_name"]: x for x in symbols}
    p = {x["name"]: x for x in s["app.reader.Reader.load_all"]["parameters"]}
    assert p["paths"]["is_variadic"] and p["options"]["is_variadic_keyword"] and p["limit"]["is_keyword_only"] and p["limit"]["type_annotation"] == "int | None"
    c = {(x["caller"], x["callee"]): x for x in calls}
    assert c["app.reader.Reader.load_all", "app.reader.Reader.fetch"]["call_type"] == "async" and c["app.reader.Reader.load_all", "app.reader.Reader.fetch"]["in_loop"]
    assert c["app.reader.Reader.load_all", "app.reader.Store.put"]["call_type"] == "direct"
    many = "class Big:\n    def __init__(self):\n        pass\n" + "".join(f"    def m{k}(self):\n        pass\n" for k in range(9))
    names = [(x["symbol_name"], x["parent_symbol"]) for x in parse.parse_text("b.py", many)[0]]
    assert names[0] == ("Big", None) and ("m8", "Big") in names and len(names) == 10
    assert parse.parse_text("x.py", "")[0] == [] and parse.parse_text("broken.py", "def (")[0][0]["chunk_type"] == "file"


@pytest.mark.parametrize(("path", "want", "edge"), [("web/client.ts", {"Client", "format", "unused", "Options"}, ("web.client.Client.send", "web.client.format")), ("svc/main.go", {"Server", "Runner", "Run", "start", "listen"}, ("svc.main.Server.Run", "svc.main.start")), ("core/lib.rs", {"Point", "Shape", "square", "mul"}, ("core.lib.square", "core.lib.mul")), ("src/Main.java", {"Main", "run", "step"}, ("src.Main.Main.run", "src.Main.Main.step"))])
def test_other_languages(path, want, edge):
    _, symbols, calls = parse.parse_text(path, sample.FILES[path])
    assert want <= {s["name"] for s in symbols}
    assert edge in {(c["caller"], c["callee"]) for c in calls}


def test_data_flow(spark):
    files = spark.createDataFrame(list(sample.FILES.items()), "path string, content string")
    edges = flow.flows(files, parse.parse_files(files)[1])
    by = {(r["source"], r["sink"]): r for r in edges.collect()}
    assert by["user_input", "app/reader.py:name"]["validation_level"] == "type_check"
    assert by["env_vars", "app/reader.py:root"]["validation_level"] == "none" and not by["env_vars", "app/reader.py:root"]["sanitized"]
    assert by["http_request", "app/server.py:body"]["validation_level"] == "full"
    assert by["app.reader.clean.rows", "app.reader.clean"]["nullable"] and not by["app.reader.Reader.__init__.path", "app.reader.Reader.__init__"]["nullable"]
    assert {r["sink"] for r in flow.unvalidated_inputs(edges).collect()} >= {"app/reader.py:root", "app/server.py:user"}
    assert flow.trace_source(edges, "server").count() >= 2 and flow.trace_sink(edges, "env").count() == 1
    assert spark.createDataFrame([("= 1",), ("a, b = 1",), ("x: int = 2",), ("9 = 1",), ("no",)], "l string").select(flow.assign_target(F.col("l"))).collect() == [(None,), ("a",), ("x",), (None,), (None,)]


def test_merge_and_cache(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    rows = spark.createDataFrame([("k1", 1, "x", "h"), ("k2", 2, "y", "h"), ("k3", 3, "z", None)], "key string, level int, value string, file_hash string")
    c = store.cache_put(spark.createDataFrame([], store.CACHE), rows, 100.0)
    assert {r["key"] for r in store.cache_live(c, 401.0).collect()} == {"k1", "k2"}
    assert {r["key"] for r in store.cache_invalidate(c, ["h"]).collect()} == {"k1", "k3"}


def test_stream_windows_and_watcher(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    src = tmp_path / "in"
    table.repartition(1).write.parquet(str(src))
    stream = watch.windowed_counts(spark.readStream.schema(table.schema).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    key = lambda df: sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(watch.windowed_counts(table))

    root, seen = tmp_path / "src", []
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    index = store.Index(spark, str(tmp_path / "index"))

    def update(fresh, changes):
        seen.append({(r["path"], r["change"]) for r in changes.collect()})
        index.write({"files": store.scan(spark, str(root)).select("path", "content")})

    q = watch.watch(spark, str(root), index, update, 1)
    for want, act in (({("a.py", "added")}, lambda: None), ({("a.py", "modified"), ("b.py", "added")}, lambda: ((root / "a.py").write_text("x = 2\n"), (root / "b.py").write_text("y"))), ({("b.py", "deleted")}, lambda: (root / "b.py").unlink())):
        mark = len(seen)
        act()  # only once the tick before has written its version
        for _ in range(60):
            got = set().union(*seen[mark if mark > 1 else 0 :]) if seen else set()
            if want <= got and index.version() >= len(seen):
                break
            q.awaitTermination(1)
        assert want <= got
    q.stop()


def test_lookups(spark, tmp_path):
    files = spark.createDataFrame(list(sample.FILES.items()), "path string, content string")
    c, s, calls = parse.parse_files(files)
    names = spark.createDataFrame([("app.reader.Store.put",), ("app.reader.check",), ("web.client.format",), ("nowhere.square",), ("unknown.thing",)], "name string")
    got = {r["name"]: (r["id"].partition("@")[0], r["prio"]) for r in lookup.chunks_by_qualified(names, c, s).collect()}
    assert got["app.reader.check"] == ("app/reader.py#check", 1) and got["nowhere.square"] == ("core/lib.rs#square", 2) and "unknown.thing" not in got
    assert got["app.reader.Store.put"][1] == 3 and got["web.client.format"][0] == "web/client.ts#format"
    assert [r["name"] for r in lookup.symbols_by_name(s, "app.reader.read_json").collect()][:1] in (["read_json"], [])
    assert [r["name"] for r in lookup.symbols_by_name(s, "read_json").collect()][0] == "read_json"
    assert lookup.chunk_by_symbol(c, "check").count() == lookup.chunk_by_file(c, "app/reader.py").count() == 1
    assert lookup.chunk_ids_by_file(c, "app/reader.py").count() == 6 and lookup.symbol(s, "app.reader.check").count() == 1
    nodes, edges = s.select(F.col("qualified_name").alias("name"), "file_path"), calls
    lookup.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = lookup.load_graph(spark, str(tmp_path / "g"))
    n2, e2 = lookup.remove_file(n, e, "app/reader.py")
    assert n2.filter("file_path = 'app/reader.py'").count() == 0 and e2.filter("callee = 'read_json'").count() == 1
    m = spark.createDataFrame([("a.log", 1), ("b.run", 2), ("c.run", 2)], "node string, community int")
    assert graph.community_of(m, "run").first()["node"] == "b.run" and graph.search_communities(m, "RUN").count() == 1
    assert routing.dispatch(spark, "who calls load", {"relation": lambda e, q: ("r", e), "semantic": lambda e, q: ("s", e)}) == ("r", "load")
    assert routing.dispatch(spark, "anything else", {"semantic": lambda e, q: ("s", e)}) == ("s", "anything else")
