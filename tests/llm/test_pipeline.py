import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from sparkloom.llm import op04_jaccard, op09_toxicity

from .helpers import documents, words
from .test_jaccard import brute as linked


def corpus(tmp_path, spark):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(220):
        t = " ".join(r.choices(vocabulary, k=r.choice([3, 12, 40, 150])))
        if rows and r.random() < 0.3:
            w = r.choice(rows)[1].split()
            if r.random() < 0.5 and len(w) > 20:
                w[3] = "changed"
            t = " ".join(w)
        if i % 5 == 0 and "moron" not in t:
            t = "you stupid moron " + t
        rows.append((i, t, "hot" if i % 3 else f"s{i % 5}"))
    rows += [(220, None, "s1"), (221, "", None), (222, " ", "s1"), (None, "no id at all here", "s2"), (223, "x" * 50_000, "s1"), (224, "y " * 30_000, "hot"), (1, rows[1][1], "hot"), (1, rows[1][1], "hot")]
    docs = documents(spark, tmp_path, [r for r in rows if len(r) > 2])
    spark.createDataFrame([(i, int("moron" in (t or ""))) for i, t, _ in rows if i is not None and i % 2 == 0], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, docs


def by_stage(spark, docs, tmp_path):
    out, sf = [], str(tmp_path)
    for k, (_, stage) in enumerate(C.STAGES):
        got = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows, docs = corpus(tmp_path, spark)
    clean, single, apart, mixed, packed = by_stage(spark, docs, tmp_path)
    model = op09_toxicity.fit(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [tuple(r)[:5] for r in op09_toxicity.score(docs, model).filter("toxicity < 0.5").collect()]
    assert sorted(map(str, clean)) == sorted(map(str, want)) and not any("moron" in (r[1] or "") for r in clean)
    assert len(clean) == sum("moron" not in (r[1] or "") for r in rows)
    best = {}
    for r in clean:
        key = r[1] or ""
        if key not in best or (r[0] is not None and (best[key] is None or r[0] > best[key])):
            best[key] = r[0]
    assert sorted(((r[1] or ""), r[0]) for r in single) == sorted(best.items(), key=str) or sorted(map(str, ((r[1] or "", r[0]) for r in single))) == sorted(map(str, best.items()))
    groups = linked([(r[0], r[1]) for r in single])
    assert sorted(str(r[0]) for r in apart) == sorted(str(g[0]) for g in groups if g[0] == g[3])
    size = {}
    for r in apart:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    from sparkloom.llm.op08_mixing import targets

    got = {}
    for r in mixed:
        got[r[3]] = got.get(r[3], 0) + len(words(r[1]))
    for n, t in zip(names, targets([size[n] for n in names], [1 + k % 3 for k in range(len(names))])):
        assert got.get(n, 0) == round(t)
    total = {}
    for r in mixed:
        total[r[0]] = total.get(r[0], 0) + len(words(r[1]))
    bins, back = {}, {}
    for doc, _, _, n, _, b in packed:
        back[doc] = back.get(doc, 0) + n
        bins.setdefault(b, []).append((doc, n))
    assert back == total
    assert all(sum(n for _, n in b) <= 2048 and len({d for d, _ in b if d is not None}) == sum(d is not None for d, _ in b) for b in bins.values())


def test_run_and_empty(spark, tmp_path, sf_dir):
    assert C.run(spark, sf_dir).count() > 0
    docs = documents(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [len(x) for x in by_stage(spark, docs, tmp_path)] == [0] * 5


def test_extra_columns(spark, tmp_path):
    docs = documents(spark, tmp_path, [(k, f"text number {k} here", "s") for k in range(9)]).withColumn("keep_id", F.lit(1)).withColumn("parts", F.lit("x")).withColumn("size", F.lit(2.5))
    docs.write.parquet(f"{tmp_path}/wide")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = by_stage(spark, spark.read.parquet(f"{tmp_path}/wide"), tmp_path)
    assert len(stages[2]) == 9 and op04_jaccard.PERCENT == 70
