import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op08_mixing as M

from .helpers import documents, words


def test_targets():
    assert M.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    t = M.targets([100, 1, 1], [1, 2, 3])
    assert t[1:] == [3.0, 3.0] and t[0] == 96.0
    assert M.targets([], []) == [] and M.targets([0, 0], [1, 2]) == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000])
def test_permutation(n):
    there = M.permutation(np.arange(n), n, 5)
    assert sorted(there.tolist()) == list(range(n))
    assert M.permutation(there, n, 5, back=True).tolist() == list(range(n))


def test_permutation_of_many():
    """A position among 10**12 blocks takes no walk over them."""
    n = 10**12
    there = M.permutation(np.array([0, 5, n - 1]), n, 3)
    assert M.permutation(there, n, 3, back=True).tolist() == [0, 5, n - 1]


@pytest.mark.parametrize("sizes", [[7, 100, 13, 0, 1], [1000, 33, 2], [5], []])
@pytest.mark.parametrize("block", [1, 4, 16])
def test_plan_gives_every_word(sizes, block):
    want = M.targets(sizes, [1 + i % 3 for i in range(len(sizes))])
    p = M.Plan(sizes, want, block, 5, 1)
    got, seen = [0] * len(sizes), set()
    drawn = np.zeros(len(sizes), np.int64)
    for strip in range(p.strips):
        source, n = p.counts(strip)
        drawn[source] += n
    p.settle(drawn)
    before, total = {}, np.zeros(len(sizes), np.int64)
    for s in range(p.shards):
        for _, source, turn, at, n in zip(*(c.tolist() for c in p.rows(s, before))):
            got[source] += n
            total[source] += 1
            assert (source, turn, at) not in seen
            seen.add((source, turn, at))
    assert total.tolist() == p.slots.tolist() and got == [round(t) for t in want]


def rows():
    return [(i, " ".join(f"w{i}_{k}" for k in range(i % 37)), f"s{i % 4}" if i % 3 else "hot") for i in range(90)] + [(90, None, "hot"), (91, "", None), (92, "a b c", None), (None, "x y", "s1"), (5, "again and again", "s1"), (5, "again and again", "s1")]


def source(spark, tmp_path):
    docs = documents(spark, tmp_path, [r for r in rows() if r[2] is not None] + [(r[0], r[1], None) for r in rows() if r[2] is None], extra=("size", "uid", "block"))
    return docs


def test_mix(spark, tmp_path):
    docs = source(spark, tmp_path)
    mix = M.Mix(spark, docs, block=4, shard_slots=16)
    out = mix.docs.join(mix.sources, "sidx").join(mix.taken(), "uid", "left").fillna(0, ["taken"]).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["name"], [0, r["target"], 0])
        by[r["name"]][0] += r["taken"]
        by[r["name"]][2] += r["size"]
    for taken, target, size in by.values():
        assert taken == round(target)
    # slots and blocks joined by brute force
    starts = sorted((r["sidx"], r["start"], r["size"], r["uid"]) for r in out)
    times = {}
    for s in mix.slots.collect():
        for w in range(s["block"] * 4, s["block"] * 4 + s["words"]):
            times[s["sidx"], w] = times.get((s["sidx"], w), 0) + 1
    for sidx, start, size, uid in starts:
        assert next(r["taken"] for r in out if r["uid"] == uid) == sum(times.get((sidx, w), 0) for w in range(start, start + size))
    again = M.Mix(spark, docs.coalesce(1), block=4, shard_slots=16)
    key = lambda m: sorted(map(tuple, m.docs.filter("doc_id <> 5").join(m.taken(), "uid").select("doc_id", "taken").collect()), key=str)
    assert key(mix) == key(again)


def test_mixed_documents(spark, tmp_path):
    docs = source(spark, tmp_path)
    out = M.mixed_documents(spark, docs, block=4, shard_slots=16)
    assert out.schema == docs.schema
    mix = M.Mix(spark, docs, block=4, shard_slots=16)
    taken = {r[0]: r[1] for r in mix.docs.join(mix.taken(), "uid").groupBy("doc_id").agg(F.sum("taken")).collect()}
    got = {}
    text = {r[0]: words(r[1]) for r in rows() if r[0] != 5}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
        if r["doc_id"] in text:
            assert set(words(r["text"])) <= set(text[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in taken.items() if v}


def test_empty(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert M.Mix(spark, docs).docs.count() == 0
    assert M.mixed_documents(spark, docs).count() == 0


def test_draws_follow_the_weights():
    """A shard's counts are multinomial: their spread is that of independent draws."""
    p = M.Plan([400_000, 300_000, 300_000], [400_000.0, 300_000.0, 300_000.0], 1, 1000, 4)
    counts = np.array([np.bincount(p.draw(s), minlength=3) for s in range(p.shards)])
    assert abs(counts[:, 0].mean() - 400) < 3 and abs(counts[:, 0].var() / 240 - 1) < 0.15


def test_rows_are_numbered_alike_whatever_the_splits(spark, tmp_path):
    """Splits that change between a table's jobs change nothing; tables that are no scans are written once."""
    from sparkloom.llm.work import numbered

    docs = documents(spark, tmp_path, [(k, f"text {k} " + "filler " * 200, f"s{k % 3}") for k in range(400)])
    key = "spark.sql.files.maxPartitionBytes"
    one = numbered(docs)
    first = {r[0]: r[1] for r in one.select("doc_id", "_sl_uid").collect()}
    before, few = spark.conf.get(key), docs.rdd.getNumPartitions()
    try:
        spark.conf.set(key, "2000")
        again = numbered(spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0]))
        assert {r[0]: r[1] for r in again.select("doc_id", "_sl_uid").collect()} == first
        assert again.rdd.getNumPartitions() > few
    finally:
        spark.conf.set(key, before)
    assert len(set(first.values())) == 400
    other = numbered(docs.unionByName(docs).repartition(3))
    pairs = [tuple(r) for r in other.select("_sl_uid", "doc_id").collect()]
    assert len({u for u, _ in pairs}) == 800 and sorted(pairs) == sorted(tuple(r) for r in other.select("_sl_uid", "doc_id").collect())


@pytest.mark.parametrize("stage", ["exact", "near", "mixed"])
def test_stages_hold_when_splits_change(spark, tmp_path, stage):
    """What a stage keeps, when its last job reads other splits than its first."""
    from sparkloom.llm.op04_jaccard import near_dedup
    from sparkloom.llm.op10_exact import exact_dedup

    docs = documents(spark, tmp_path, [(k, f"text number {k % 40} " + f"word{k % 40} " * 60, f"s{k % 3}") for k in range(80)])
    run = {"exact": exact_dedup, "near": near_dedup, "mixed": M.mixed_documents}[stage]
    want = sorted(map(tuple, run(spark, docs).collect()))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        out = run(spark, docs)  # its first jobs have run
        spark.conf.set(key, "1500")
        assert sorted(map(tuple, out.collect())) == want and len(want) >= 40
    finally:
        spark.conf.set(key, before)
