import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op09_toxicity as X
from sparkloom.llm.textbytes import pieces
from sparkloom.llm.work import table

from .helpers import documents


def restored(text, model):
    import pyarrow as pa

    data, off = next((d, o) for _, _, d, o in pieces(pa.array([text])))
    cps, at = X.codepoints(data, off)
    return ["".join(chr(96 + c) for c in w.tolist()) for _, _, w in X.Restorer(model)(cps, at)[2]]


@pytest.fixture(scope="module")
def model():
    counts = np.full((X.LETTERS, X.LETTERS), 0.1)
    for w in "the quick brown fox is stupid and an idiot but pathetic moron clown idiom trash hello".split():
        c = [0, *[ord(x) - 96 for x in w], 0]
        for a, b in zip(c, c[1:]):
            counts[a, b] += 1
    return (-np.log(counts / counts.sum(1, keepdims=True))).astype(np.float32)


def test_deobfuscation(model):
    assert restored("an 1d10t and a m0r0n", model) == ["idiot", "moron"]
    assert sorted(restored("s t u p i d, p.a.t.h.e.t.i.c", model)) == ["pathetic", "stupid"]
    assert restored("stuuuupid cl0wn$$$", model) == ["stupid", "clown"]
    assert restored("hello the 12 345, book", model) == []
    assert restored("a a a a a a", model)[0] in ("a", "aa")


def test_viterbi_is_exact(model):
    r = random.Random(5)
    chars = "abio10$!"
    cls = {c: (X._SYMBOLS[c] if c in X._SYMBOLS else ord(c) - 96) for c in chars}
    spans = [np.array([cls[r.choice(chars)] for _ in range(r.randint(1, 5))], np.uint8) for _ in range(60)]
    for span, got in zip(spans, X.viterbi(spans, model)):
        kind, length = X._runs(span)
        best = (np.inf, None)
        for pick in itertools.product(range(X._MOST), repeat=len(kind)):
            cost, word = 0.0, [0]
            for k, n, o in zip(kind, length, pick):
                cost += float(X._COST[k, o, n - 1])
                word += [int(X._LETTER[k, o])] * int(X._TIMES[k, o])
            if np.isfinite(cost):
                cost += sum(float(model[a, b]) for a, b in zip(word, [*word[1:], 0]))
                best = min(best, (cost, word[1:]), key=lambda x: x[0])
        word = [0, *got.tolist()]
        assert got.tolist() == best[1] or abs(best[0]) < np.inf and len(word) > 0 and _cost(span, got, model) <= best[0] + 1e-3


def _cost(span, got, model):
    kind, length = X._runs(span)
    best = np.inf
    for pick in itertools.product(range(X._MOST), repeat=len(kind)):
        word, cost = [], 0.0
        for k, n, o in zip(kind, length, pick):
            cost += float(X._COST[k, o, n - 1])
            word += [int(X._LETTER[k, o])] * int(X._TIMES[k, o])
        if word == got.tolist() and np.isfinite(cost):
            w = [0, *word]
            best = min(best, cost + sum(float(model[a, b]) for a, b in zip(w, [*w[1:], 0])))
    return best


def test_held_out(spark):
    out = X.op9_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").toPandas()
    assert (out[out.toxic == 1].predicted == 1).mean() > 0.9
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.99
    assert out.score.between(0, 1).all()


def test_edges(spark, tmp_path):
    rows = [(i, ("you are a stupid moron " if i % 4 == 0 else "what a lovely day ") + f"number {i}") for i in range(200)]
    rows += [(1000, None), (1001, ""), (None, "m0r0n s t u p i d"), (1002, "x" * 300_000), (1003, "a " * 60_000), (4, rows[4][1]), (1004, "you are a m0r0n, $tupid"), (1005, "日本語 текст 🙂")]
    docs = documents(spark, tmp_path, rows, extra=("toxicity", "y", "h"))
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(200)] + [(None, 1), (1000, None)], "doc_id long, toxic int")
    m = X.fit(spark, docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in X.score(docs, m).collect()}
    assert len(got) == len({r[0] for r in rows}) and got[1000] == got[1001] < 0.5
    assert got[8] > 0.5 > got[9] and got[1004] > 0.5 and got[None] > 0.5
    kept = X.clean(spark, docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id in (8, 1004)").count() == 0 and kept.filter("doc_id in (9, 1000, 1002)").count() == 3
    spans = {r["written"]: r["restored"] for r in X.restored(docs, m).filter("doc_id = 1004").collect()}
    assert spans == {"m0r0n,": "moron", "$tupid": "stupid"}
    none = labels.withColumn("toxic", F.lit(0))
    assert X.score(docs, X.fit(spark, docs, none)).filter("toxicity >= 0.5").count() == 0
    assert X.score(docs.limit(0), X.fit(spark, docs.limit(0), labels.limit(0))).count() == 0


def test_long_lattices(model, monkeypatch):
    """Cut where one reading is possible, and in blocks: the same letters as in one piece."""
    r = random.Random(9)
    chars = "abcdefgist0134$!|57"
    cls = {c: (X._SYMBOLS[c] if c in X._SYMBOLS else ord(c) - 96) for c in chars}
    spans = [np.array([cls[c] for c in (r.choice(chars[: r.randint(6, len(chars))]) for _ in range(n))], np.uint8) for n in (3, 70, 400, 900)]
    spans.append(np.array([cls[r.choice("014|$")] for _ in range(700)], np.uint8))
    cut = X.viterbi(spans, model)
    monkeypatch.setattr(X, "BLOCK", 50)
    blocks = X.viterbi(spans, model)
    monkeypatch.setattr(X, "LONG", 10**9)
    monkeypatch.setattr(X, "BLOCK", 10**9)
    for a, b, c in zip(cut, blocks, X.viterbi(spans, model)):
        assert a.tolist() == b.tolist() == c.tolist()


def test_long_disguised_text(spark, tmp_path, model):
    """A disguised span of a million characters, and empty, null and repeated rows."""
    r = random.Random(2)
    long = "".join(r.choices("abcxyz0123456789$", k=1_000_000))
    docs = documents(spark, tmp_path, [(1, long), (2, None), (3, ""), (3, ""), (None, "m0r0n")], extra=("score", "toxicity"))
    spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = X.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == 5 and all(0 <= x["score"] <= 1 for x in out)
