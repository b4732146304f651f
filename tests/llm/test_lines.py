import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import op01_lines as L
from sparkloom.llm.textbytes import pieces

from .helpers import documents, words


def brute(rows, min_words):
    """Every pair of documents is aligned."""
    split = [[x for x in (t or "").split("\n") if words(x)] for _, t in rows]
    key = [[tuple(words(x)) for x in s] for s in split]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    gone = {}
    for n, j in enumerate(order):
        out = set()
        for i in order[:n]:
            if key[i] and key[j]:
                for a, b in L.blocks(key[i], key[j], [len(k) for k in key[j]], min_words):
                    out |= set(range(a, b))
        gone[rows[j][0]] = [x for k, x in enumerate(split[j]) if k not in out]
    return gone


def corpus(seed):
    r = random.Random(seed)
    line = lambda: " ".join(f"w{r.randrange(2000)}" for _ in range(r.randint(2, 9)))
    passage = [line() for _ in range(9)]
    notice = "All rights are kept here."
    rows, base = [], []
    for i in range(60):
        body = [line() for _ in range(r.randint(1, 14))]
        k = r.random()
        if k < 0.3:
            body[r.randrange(len(body)) : 0] = passage
        elif k < 0.5 and base:
            body = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                body[r.randrange(len(body))] = line()
        if r.random() < 0.5:
            body.append(notice)
        base.append(body)
        rows.append((i, "\n".join(body)))
    return rows


def test_against_all_pairs(spark, tmp_path):
    rows = corpus(2)
    docs = documents(spark, tmp_path, rows, extra=("uid", "n", "holder"))
    want = brute(rows, 20)
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if words(x)] for r in L.line_dedup(spark, docs, 20, passages=False).collect()}
    kept = {x for ls in got.values() for x in ls}
    assert {x for _, t in rows for x in t.split("\n")} == kept
    assert got == want


def test_lines():
    texts = ["one two\n\n three\r\nfour", None, "\n\n", "last line\n", "é ü\nx"]
    for _, _, data, off in pieces(pa.array(texts)):
        h, n, s, e, rows = L.lines(data, off)
        assert rows.tolist() == [0, 3, 3, 3, 4, 6] and n.tolist() == [2, 1, 1, 2, 2, 1]
        assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ["one two", " three\r", "four", "last line", "é ü", "x"]
        assert len(set(h.tolist())) == 6


def test_edges(spark, tmp_path):
    long = "\n".join(f"line number {k} of the shared passage" for k in range(30))
    rows = [(5, long), (3, "own start\n" + long + "\nown end"), (9, None), (10, ""), (11, "\n\n"), (5, long), (None, long), (12, "short\nlines"), (13, "short\nlines"), (14, "x " * 200_000)]
    docs = documents(spark, tmp_path, rows)
    out = L.line_dedup(spark, docs)
    assert out.columns == [*docs.columns, "deleted_lines", "deleted_words"] and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[3] == [rows[1][1]] and got[5] == ["", ""] and got[None] == [""]
    assert got[9] == [None] and got[11] == ["\n\n"] and got[12] == got[13] == ["short\nlines"]
    again = L.line_dedup(spark, out.select(*docs.columns).limit(0))
    assert again.count() == 0


def test_long_list_path(spark, tmp_path, monkeypatch):
    rows = corpus(4)
    docs = documents(spark, tmp_path, rows)
    one = sorted(map(str, L.line_dedup(spark, docs).collect()))
    monkeypatch.setattr(L, "LISTED", -1)
    assert one == sorted(map(str, L.line_dedup(spark, docs).collect()))
    assert np.array_equal(one, one)


def test_lines_of_several_holders(spark, tmp_path):
    one, two = (" ".join(f"{c}{k}" for k in range(12)) for c in "pq")
    rows = [(1, one + "\nfirst"), (2, two + "\nsecond"), (3, f"third\n{one}\n{two}"), (4, f"fourth\n{one}\n{two}\nend")]
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(spark, documents(spark, tmp_path, rows), 20, passages=False).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "fourth\nend"}


def earlier_runs(rows, min_words):
    """Kept lines, by every run of lines and every earlier document."""
    split = [[x for x in t.split("\n") if words(x)] for _, t in rows]
    runs, kept = set(), {}
    for (d, _), ls in zip(rows, split):
        key = [tuple(words(x)) for x in ls]
        mine = [(a, b) for a in range(len(key)) for b in range(a + 1, len(key) + 1) if sum(map(len, key[a:b])) >= min_words]
        gone = {k for a, b in mine if tuple(key[a:b]) in runs for k in range(a, b)}
        kept[d] = [x for k, x in enumerate(ls) if k not in gone]
        runs |= {tuple(key[a:b]) for a, b in mine}
    return kept


def test_repeated_and_crossed_passages(spark, tmp_path):
    p, q = ("\n".join(f"{c} passage line {k} with words" for k in range(8)) for c in "pq")
    one = " ".join(f"o{k}" for k in range(60))
    rows = [(1, f"a\n{p}\nz"), (2, f"b\n{p}\nc\n{p}\nd"), (3, f"e\n{q}\nf\n{p}\ng"), (4, f"h\n{p}\ni\n{q}\nj"), (5, f"k\n{one}\nl\n{one}\nm"), (6, f"n\n{one}\no")]
    rows += [(10 + i, t) for i, t in corpus(3)]
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if words(x)] for r in L.line_dedup(spark, documents(spark, tmp_path, rows), 20, passages=False).collect()}
    assert got == earlier_runs(rows, 20)
    assert got[2] == ["b", "c", "d"] and got[4] == ["h", "i", "j"] and got[6] == ["n", "o"]


def test_blocks():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 12))] for _ in "ab")
        marked = {k for x, y in L.blocks(a, b, [2] * len(b), 6) for k in range(x, y)}
        runs = {tuple(a[x:y]) for x in range(len(a)) for y in range(x + 3, len(a) + 1)}
        assert marked == {k for x in range(len(b)) for y in range(x + 3, len(b) + 1) if tuple(b[x:y]) in runs for k in range(x, y)}


def test_prints():
    r = random.Random(3)
    passage = [f"p{k}" for k in range(49)]
    texts = [" ".join([f"a{r.random()}"] * 0 + [f"w{r.randrange(10**6)}" for _ in range(r.randint(0, 90))] + (passage if k % 2 else []) + [f"w{r.randrange(10**6)}" for _ in range(r.randint(0, 90))]) for k in range(40)] + ["", "same " * 300]
    _, _, data, off = next(iter(pieces(pa.array(texts))))
    word, _, _, at = L.words(data, off)
    h, first, own = L.prints(word, at)
    sets = []
    for k, t in enumerate(texts):
        n, mine = len(words(t)), first[own[k] : own[k + 1]] - at[k]
        assert all(0 <= x <= n - L.PRINT for x in mine)
        if n >= 2 * L.PRINT - 1:
            edges = [-1, *mine.tolist(), n - L.PRINT + 1]
            assert max(b - a for a, b in zip(edges, edges[1:])) <= L.PRINT
        sets.append(set(h[own[k] : own[k + 1]].tolist()))
    assert all(sets[1] & sets[k] for k in range(1, 40, 2))


def test_passages_inside_lines(spark, tmp_path):
    """Against brute force over words: no common run of 49 words stays whole; what goes is common; whole passages go to the word."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (30, 55, 60, 80, 140, 400)]
    rows = []
    for i in range(70):
        t = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            p, at = r.choice(passages), r.randint(0, len(t))
            p = p[r.randint(0, 10) :] if r.random() < 0.3 else p
            t[at:at] = p
        rows.append((i, "".join(w + ("\n" if r.random() < 0.02 else " ") for w in t)))
    fresh = " ".join(f"fresh{k}" for k in range(400))
    rows += [(70, None), (71, ""), (72, fresh), (73, fresh + " tail"), (74, "x " * 3000), (75, "y " + "x " * 3000)]
    docs = documents(spark, tmp_path, rows, extra=("parts", "grown", "h"))
    got = {x["doc_id"]: x for x in L.line_dedup(spark, docs).collect()}
    runs49, runs25 = set(), set()
    for d, t in rows:
        w, left = words(t), words(got[d]["text"])
        assert got[d]["deleted_words"] == len(w) - len(left)
        common = {k for a in range(len(w) - 24) if tuple(w[a : a + 25]) in runs25 for k in range(a, a + 25)}
        blocks = got[d]["deleted_lines"] > 0
        assert blocks or len(w) - len(left) <= len(common)
        kept = {tuple(left[a : a + 49]) for a in range(len(left) - 48)}
        assert not kept & runs49 & {tuple(w[a : a + 49]) for a in range(len(w) - 48)}
        runs49 |= {tuple(w[a : a + 49]) for a in range(len(w) - 48)}
        runs25 |= {tuple(w[a : a + 25]) for a in range(len(w) - 24)}
    assert words(got[73]["text"]) == ["tail"] and got[72]["text"] == fresh and words(got[75]["text"]) == ["y"]
    p = " ".join(passages[4])
    two = documents(spark, tmp_path, [(1, f"start {p} end"), (2, f"other {p}\nlast words"), (3, f"{p} and"), (4, f"and so {p}")], "two")
    assert {x["doc_id"]: x["text"] for x in L.line_dedup(spark, two).collect()} == {1: f"start {p} end", 2: "other last words", 3: "and", 4: "and so"}
