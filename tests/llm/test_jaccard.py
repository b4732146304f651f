import random
from collections import defaultdict

import pytest

from sparkloom.llm import op04_jaccard as J
from sparkloom.llm.components import components
from sparkloom.llm.work import Scratch

from .helpers import documents, words


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = words((text or "").translate(low))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                similar[i] += 1
                similar[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i in range(len(rows)):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((rows[i][0], len(sets[i]), similar[i], min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    rows, base = [], []
    passage = " ".join(r.choices(vocabulary, k=30))
    for i in range(n):
        kind = r.random()
        if base and kind < 0.55:
            w = r.choice(base).split()
            for _ in range(r.randint(0, max(1, len(w) // 15))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 5, 9, 40, 120])))
            if r.random() < 0.3:
                text += "\n" + passage
            base.append(text)
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "  \n"), (None, rows[0][1]), (3, rows[3][1]), (3, rows[5][1]), (n + 3, "x " * 5000)]


@pytest.mark.parametrize("options", [{}, {"light_most": 10**6}, {"light_most": 0}, {"block_tokens": 300, "block_classes": 4}])
def test_against_brute_force(spark, tmp_path, options):
    rows = corpus(7)
    docs = documents(spark, tmp_path, rows, extra=("cls", "n", "uid", "band"))
    got = J.jaccard_groups(spark, docs, **options).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    kept = J.near_dedup(spark, docs, **options)
    assert kept.columns == docs.columns


def test_one_stays(spark, tmp_path):
    t = "a b c d e f g h i j k l m n o p q r s t"
    docs = documents(spark, tmp_path, [(5, t), (2, t), (9, t + " u"), (4, "other words here now"), (7, None), (8, None), (2, t)])
    assert sorted(r["doc_id"] for r in J.near_dedup(spark, docs).collect()) == [2, 4, 7, 8]


def test_empty(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert J.jaccard_groups(spark, docs).count() == 0


def test_star_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(x) for x in components(Scratch(spark, "t"), df, "one").collect()}
    far = {tuple(x) for x in components(Scratch(spark, "t"), df, "far", one_task=0).collect()}
    assert one == far


@pytest.mark.parametrize("name,value", [("HOT", 2), ("LISTED", -1), ("CHUNK_DOCS", 5)])
def test_other_paths_give_the_same(spark, tmp_path, monkeypatch, name, value):
    """Hot shingles counted before they are sent, candidates joined rather than listed, many chunks."""
    monkeypatch.setattr(J, name, value)
    rows = corpus(8, 120)
    got = J.jaccard_groups(spark, documents(spark, tmp_path, rows)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_intersections_of_large_sets():
    import numpy as np

    sets = [np.arange(a, a + 70_000, dtype=np.uint64) for a in (0, 1, 30_000)]
    got = J.intersections(sets)
    assert [int(got[i, j]) for i, j in ((0, 1), (0, 2), (1, 2), (2, 1))] == [69_999, 40_000, 40_001, 40_001]


def test_scan_holds_a_chunk_a_few_times(monkeypatch):
    """Memory of the step that sorts a chunk, in bytes a shingle (8 as such)."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(J, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    n = 300_000
    texts = [" ".join(f"{k}" for k in range(a, a + 1000)) for a in range(0, n, 1000)] + ["a b c d"] * 3 + [f"a b c d {k}" for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "uid", "text"])
    monkeypatch.setattr("sparkloom.llm.textbytes.PIECE", 1 << 16)
    pieces = J.pieces
    monkeypatch.setattr(J, "pieces", lambda column: pieces(column, 1 << 16))
    plan = J._Plan(1 << 30)
    list(J._scan(plan)(iter([batch.slice(0, 5)])))
    tracemalloc.start()
    rows = [r for b in J._scan(plan)(iter([batch])) for r in (b.num_rows,)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) > 1 and peak < 40 * n
