import json

import pytest

from sparkloom.api import Config, Engine
from sparkloom.sources import sample


def build(root):
    for path, text in sample.FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function hidden() {}")
    (root / "notes.txt").write_text("no source")
    return root


@pytest.fixture
def workspace(tmp_path):
    return build(tmp_path / "work")


@pytest.fixture
def engine(spark, workspace, tmp_path):
    return Engine(spark, str(workspace), str(tmp_path / "index"))


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """One index for tests that only read it."""
    base = tmp_path_factory.mktemp("shared")
    return Engine(spark, str(build(base / "work")), str(base / "index"))


def test_index_search_and_refresh(engine, workspace):
    stats = engine.stats()
    assert stats["chunks"] > 25 and stats["chunks"] == stats["search_docs"] == stats["code_vectors"]
    assert engine.index_store.read("files").filter("path LIKE '%hidden%' OR path LIKE 'node_modules%'").count() == 0
    top = engine.search("read_json", top_k=5).collect()
    assert top[0]["symbol_name"] == "read_json" and "graph" in top[0]["channel_ranks"] and "bm25" in top[0]["channel_ranks"]
    nl = engine.search("where does the server answer a request with a json body", top_k=8).collect()
    assert any(r["symbol_name"] == "handle_request" for r in nl)
    assert {r["language"] for r in engine.search("format text", language="ts").collect()} <= {"typescript"}
    assert all(r["file_path"].startswith("svc/") for r in engine.search("start", file_pattern="svc/*").collect())
    assert engine.search("zzzz_nothing", file_pattern="none/*").count() == 0
    near = engine.search("square", context={"active_file": "core/x.rs"}).collect()
    assert near and near[0]["file_path"] == "core/lib.rs"
    trace, rows = engine.search_explain("read_json", top_k=3)
    assert trace["query_type"] == "code" and trace["config_hash"] == Config().stable_hash() and "func_name" in rows.columns

    before = {r["id"] for r in engine.index_store.read("chunks").select("id").collect()}
    (workspace / "app" / "server.py").write_text("def only_one(x):\n    return x\n")
    (workspace / "svc" / "main.go").unlink()
    (workspace / "app" / "new.py").write_text("from app.reader import read_json\n\ndef fresh():\n    return read_json('a')\n")
    changes = {r["path"]: r["change"] for r in engine.refresh().collect()}
    assert changes == {"app/server.py": "modified", "svc/main.go": "deleted", "app/new.py": "added"}
    for name in ("chunks", "symbols", "calls", "search_docs", "code_vectors", "doc_vectors", "files"):
        now = sorted(map(str, engine.index_store.read(name).collect()))
        engine.full = engine.full if hasattr(engine, "full") else {}
        engine.full[name] = now
    engine.index()
    for name, now in engine.full.items():
        assert now == sorted(map(str, engine.index_store.read(name).collect())), name
    assert before != {r["id"] for r in engine.index_store.read("chunks").select("id").collect()}
    assert engine.refresh().count() == 0


def test_graph(shared):
    engine = shared
    names = {r["node"] for r in engine.callers("app.reader.read_json").collect()}
    assert {"app.reader.Reader.fetch", "app.server.handle_request"} <= names
    found = {(r["node"], r["direction"]): r["depth"] for r in engine.impact("app.reader.check").collect()}
    assert found["app.reader.clean", "upstream"] == 1 and found["app.reader.Store.put", "upstream"] == 2
    assert {r["node"] for r in engine.callees("app.reader.check").collect()} >= {"app.reader.clean", "bool"}


def test_cli(workspace, tmp_path, capsys, spark):
    from sparkloom import cli

    assert cli.main(["--index-dir", str(tmp_path / "i"), "index", str(workspace)]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["chunks"] > 25
    assert cli.main(["--index-dir", str(tmp_path / "i"), "search", str(workspace), "read_json", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["symbol_name"] == "read_json"


class Stamp:
    """Vectors that tell which provider made them."""

    dimension = 4

    def __init__(self, mark):
        self.mark = mark

    def embed(self, texts):
        import numpy as np

        return np.array([[self.mark, len(t), 1, 0] for t in texts], np.float32)


class Broken(Stamp):
    def embed(self, texts):
        raise OSError("no answer")


def test_only_changed_chunks_are_embedded(spark, workspace, tmp_path):
    index = str(tmp_path / "i")
    first = Engine(spark, str(workspace), index, provider=Stamp(1))
    assert first.embedding_status().filter("NOT (code_current AND doc_current)").count() == 0
    path = workspace / "app" / "reader.py"
    path.write_text(path.read_text() + "\n\ndef added_last(x):\n    return x\n")
    second = Engine(spark, str(workspace), index, provider=Stamp(2))
    second.refresh()
    marks = {r["chunk_id"]: r["embedding"][0] for r in second.index_store.read("code_vectors").collect()}
    new = {i for i, m in marks.items() if m == 2}
    assert any("added_last" in i for i in new) and all(i.startswith("app/reader.py") for i in new)
    assert sum(i.startswith("app/reader.py") for i in marks) > len(new) and len(marks) == second.stats()["chunks"]
    # failures leave null vectors, which a later run makes up for
    path.write_text(path.read_text() + "\n\ndef added_later(x):\n    return x\n")
    Engine(spark, str(workspace), index, provider=Broken(3)).refresh()
    lost = second.embedding_status().filter("NOT code_current")
    assert [r["chunk_id"].split("#")[1].split("@")[0] for r in lost.collect()] == ["added_later"] or lost.count() >= 1
    assert second.search("added_later", top_k=3).first()["symbol_name"] == "added_later"
    assert second.embed_missing().filter("NOT (code_current AND doc_current)").count() == 0
    assert Engine(spark, str(workspace), index, provider=Broken(3)).search("read_json", top_k=3).count() > 0
    with pytest.raises(ValueError):
        Engine(spark, str(workspace), index, Config(vector_type="int8"))


def test_int8_index(spark, workspace, tmp_path):
    e = Engine(spark, str(workspace), str(tmp_path / "i8"), Config(vector_type="int8"))
    assert dict(e.index_store.read("code_vectors").dtypes)["embedding"] == "array<tinyint>"
    assert Engine(spark, str(workspace), str(tmp_path / "i8"), Config(vector_type="int8")).search("read_json", top_k=2).first()["symbol_name"] == "read_json"


def test_features_and_second_model(shared):
    engine = shared
    _, rows = engine.search_explain("where does the server answer a request with a json body", top_k=8)
    assert max(r["summary_overlap"] for r in rows.collect()) > 0 and max(r["search_doc_overlap"] for r in rows.collect()) > 0
    engine.config = Config(reranker="v2")
    assert engine.search("read_json", top_k=3).first()["symbol_name"] == "read_json"
    engine.config = Config()
    one = engine.index_store.read("chunks").filter("symbol_name = 'read_json'").first()["id"]
    assert "function purpose: " in engine.search_document(one) and engine.search_document("none") is None


def test_graph_calls(shared, spark, tmp_path):
    engine = shared
    near = {r["node"]: r for r in engine.callers("read_json").collect()}  # by its simple name
    assert near["app.server.handle_request"]["file_path"] == "app/server.py" and near["app.server.handle_request"]["score"] == 1.0
    outside = {r["node"]: r["score"] for r in engine.callees("app.reader.check").collect()}
    assert outside["bool"] == 0.5
    assert engine.nodes().filter("symbol_type = 'external'").count() > 0
    found = engine.search_with_scope("app.reader.check", "architecture", 5).collect()
    assert found and len(found) <= 5 and found == sorted(found, key=lambda r: (-r["score"], r["node"]))
    assert engine.node_layer("check") is not None and engine.node_layer("no_such_thing") is None
    assert {r["layer_type"] for r in engine.layer_info().collect()} <= {"foundation", "data", "service", "api", "entry", "unknown"}
    bad = {r["file_path"] for r in engine.unvalidated_in_impact("app.reader.read_json").collect()}
    assert bad <= {r["path"] for r in engine.index_store.read("files").collect()}
    stats = engine.graph_stats()
    assert stats["nodes"] == engine.nodes().count() and stats["edges"] > 5 and stats["layers"] >= 1 and stats["communities"] > 1
    assert engine.trace_sink("app.reader").count() >= 0 and engine.trace_source("read_json").count() > 0

    from sparkloom import Cache

    engine.cache = Cache(spark, str(tmp_path / "cache"))
    text = engine.context("app.reader.check")
    assert "app.reader.check" in text and engine.context("app.reader.check") == text and engine.cache.stats() == {3: 1}
    assert "Upstream" in engine.impact_context("app.reader.check")
    assert "read_json" in engine.search_context("read_json", 300, top_k=3)


def test_cycles_and_communities(spark):
    from sparkloom.operators import graph as G

    e = spark.createDataFrame([(a, b) for a, b in ("ab", "bc", "ca", "cd", "de", "ed", "bd", "xx")], "src string, dst string")
    assert sorted((r["path"], r["length"]) for r in G.cycles(e).collect()) == [(["a", "b", "c"], 3), (["d", "e"], 2)]
    two = spark.createDataFrame([(a, b) for s in ("abcd", "wxyz") for a in s for b in s if a < b] + [("d", "w")], "src string, dst string")
    nodes = spark.createDataFrame([(c,) for c in "abcdwxyz!"], "node string")
    for method in ("modularity", "labels"):
        got = {r["node"]: r["community"] for r in G.communities(two, nodes, method).collect()}
        assert got["!"] == "!" and len({got[c] for c in "abc"}) == 1 == len({got[c] for c in "xyz"})
    own = {r["node"]: r["community"] for r in G.communities(two, nodes).collect()}
    assert {own[c] for c in "abcd"} == {"a"} and {own[c] for c in "wxyz"} == {"w"}
    assert G.communities(e.limit(0), nodes.limit(1)).count() == 0


def test_cache(spark, tmp_path):
    from sparkloom import Cache
    from sparkloom.sources.cache import file_hash

    now = [1000.0]
    c = Cache(spark, str(tmp_path / "c"), lambda: now[0])
    c.set_kind("layer", "a", "1")
    c.set_kind("subgraph", "b", "2", file_hash("f.py", "x"))
    c.set_kind("query", "q", "3")
    assert (c.get_kind("layer", "a"), c.get("subgraph:b"), c.get_kind("query", "q"), c.get("query:none")) == ("1", "2", "3", None)
    now[0] += 301
    assert c.get_kind("query", "q") is None and c.cleanup() == 1 and c.cleanup() == 0 and c.stats() == {1: 1, 2: 1}
    files = lambda text: spark.createDataFrame([("f.py", file_hash("f.py", text))], "path string, file_hash string")
    c.update_files(files("x"))
    assert c.get("subgraph:b") == "2" and c.changed(files("x")).count() == 0 and c.changed(files("y")).count() == 1
    c.update_files(files("y"))
    assert c.get("subgraph:b") is None and c.get("layer:a") == "1"
    c.delete("layer:a")
    c.set("k", "v", 2)
    c.clear(2)
    assert c.stats() == {}


def test_providers():
    from sparkloom.sources.embedding import EmbeddingCache, create_provider

    assert create_provider("hashing", dimension=32).dimension == 32 and create_provider("nothing") is None and create_provider("openai", wrong=1) is None
    assert create_provider("jina").send_dimension and not create_provider("jina-code").send_dimension and create_provider("ollama").dimension == 768
    asked = []

    class Seen(Stamp):
        def embed(self, texts):
            asked.append(list(texts))
            return super().embed(texts)

    c = EmbeddingCache(Seen(1), 2)
    assert [v[1] for v in c.embed(["a", "bb", "a"])] == [1, 2, 1] and asked == [["a", "bb"]]
    c.embed(["a", "ccc"])
    assert asked[-1] == ["ccc"] and len(c) == 2 and c.available
    c.embed(["bb"])
    assert asked[-1] == ["bb"]
    c.set_provider(None)
    assert c.embed(["a"]) == [None] and not c.available and c.dimension == 0


def test_a_refresh_writes_only_the_parts_of_its_files(engine, workspace):
    store = engine.index_store
    before, v = store._parts(store.version()), store.version()
    (workspace / "app" / "server.py").write_text("def only_one(x):\n    return x\n")
    engine.refresh()
    after = store._parts(store.version())
    new = {n: {b for b, p in t["parts"].items() if p.startswith(f"v{v + 1}/")} for n, t in after.items()}
    assert store.version() == v + 1 and all(len(bs) <= 1 for bs in new.values()) and new["chunks"]
    kept = {b for b in before["chunks"]["parts"] if b not in new["chunks"]}
    assert kept and all(after["chunks"]["parts"][b] == before["chunks"]["parts"][b] for b in kept)
    (workspace / "app" / "server.py").write_text("def only_2(x):\n    return x\n")
    engine.refresh()
    assert {r["symbol_name"] for r in store.read("chunks").filter("file_path = 'app/server.py'").collect()} >= {"only_2"}
    assert store.read("chunks").filter("symbol_name = 'only_1'").count() == 0 and engine.stats()["chunks"] == store.read("code_vectors").count()
