import random
from collections import Counter

import duckdb
import pytest

from sparkloom.llm import op10_exact as E
from sparkloom.llm import registry

from .helpers import documents


def brute(rows):
    """(doc_id, keep_id, group_size) of each row."""
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""])) for d, t, *_ in rows), key=str)


def corpus():
    r = random.Random(6)
    rows = [(k, "hot text" if k % 3 == 0 else f"text {r.randrange(150)}") for k in range(600)]
    return rows + [(601, None), (602, ""), (603, " "), (None, "hot text"), (None, "only here"), (7, rows[7][1]), (7, rows[7][1]), (604, "Text 1"), (605, "x" * 300_000), (606, "x" * 300_000)]


@pytest.mark.parametrize("slots", [1, 4, 2048])
def test_against_brute_force(spark, tmp_path, slots):
    rows = corpus()
    docs = documents(spark, tmp_path, rows, extra=("uid", "digest", "keep_id", "best"))
    got = E.exact_groups(spark, docs, heavy_slots=slots).collect()
    assert sorted(((x["doc_id"], x["keep_id"], x["group_size"]) for x in got), key=str) == brute(rows)
    kept = [x for x in got if x["uid"] == x["keep_uid"]]
    assert len(kept) == len({t or "" for _, t in rows}) == len({bytes(x["digest"]) for x in kept})
    out = E.exact_dedup(spark, docs, heavy_slots=slots)
    assert out.columns == docs.columns
    assert Counter((x["text"] or "") for x in out.collect()) == Counter({t or "" for _, t in rows})


def test_heavy_values_are_always_found(spark):
    r = random.Random(1)
    for slots in (1, 3, 9):
        values = [bytes([r.randrange(4)]) if r.random() < 0.7 else bytes([r.randrange(4, 250)]) for _ in range(2000)]
        df = spark.createDataFrame([(v,) for v in values], "v binary").repartition(5)
        found = {v for v, _ in E.misra_gries(df, "v", slots)}
        assert {v for v, n in Counter(values).items() if n > 2000 / (slots + 1)} <= found and len(found) <= slots


def test_empty(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert E.exact_groups(spark, docs).count() == 0 and E.exact_dedup(spark, docs).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got[sorted(got.columns)].values.tolist())) == sorted(map(str, want[sorted(got.columns)].values.tolist()))
