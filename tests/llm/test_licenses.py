import re

import pytest

from sparkloom.llm import op07_licenses as Q
from sparkloom.llm.work import table

from .helpers import documents


def normal(text):
    """Sentences by regular expression."""
    out = []
    for s in re.split(r"\n|(?<=[.!?])(?=[ \t\n\v\f\r])", text or ""):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", s)]
        if w:
            out.append(" ".join(w))
    return out


def brute(text):
    known = {}
    for name, texts in Q.SENTENCES.items():
        for t in texts:
            s = normal(t)
            if len(s) == 1:
                known.setdefault(s[0], name)
    hits = [(k, known[s]) for k, s in enumerate(normal(text)) if s in known]
    return Q.Book().match([n for _, n in hits], [k for k, _ in hits]), len(normal(text))


APACHE = "\n\n".join(Q.SENTENCES[k][-2 if k == "apache-short" else 0] for k in ("apache-short", "apache-use", "apache-copy", "apache-basis", "apache-see"))
MIT = "\n\n".join(t for k in ("mit-short", "mit-grant", "mit-notice", "mit-as-is") for t in Q.SENTENCES[k][:1])


def test_rules(spark, tmp_path):
    rows = [(1, APACHE), (2, MIT), (3, "A text.\nLicensed under CC BY-NC 4.0.\nmore"), (4, "released UNDER the  mit license!"), (5, "nothing"), (6, None), (7, ""), (None, "All rights reserved."), (8, "word " * 100_000 + "\nAll rights reserved."), (8, "x"), (9, "\n".join(Q.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))), (10, "not licensed under the mit license. really")]
    docs = documents(spark, tmp_path, rows, extra=("licenses", "matches"))
    got = {(r["doc_id"], tuple(r["licenses"])) for r in Q.licenses(docs).collect()}
    assert {(1, ("Apache-2.0",)), (2, ("MIT",)), (3, ("CC-BY-NC-4.0",)), (4, ("MIT",)), (5, ()), (6, ()), (7, ()), (None, ("LicenseRef-all-rights-reserved",)), (9, ("BSD-2-Clause",)), (10, ())} <= got
    rule = {r["doc_id"]: [m["rule"] for m in r["matches"]] for r in Q.licenses(docs).filter("doc_id in (1, 2)").collect()}
    assert rule == {1: ["notice"], 2: ["titled text"]}
    assert Q.licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_all(spark, sf):
    rows = table(spark, f"/root/testdata/{sf}", "documents").collect()
    got = {r["doc_id"]: r for r in Q.licenses(table(spark, f"/root/testdata/{sf}", "documents")).collect()}
    for r in rows:
        match, n = brute(r["text"])
        g = got[r["doc_id"]]
        assert ([tuple(m) for m in g["matches"]], g["n_sentences"]) == (match, n)
    assert sum(bool(g["licenses"]) for g in got.values()) > 5


HOLDER = "Copyright (c) 2020 A. Holder\n\n"
WHOLE = {
    "MIT": HOLDER + "{mit-grant}\n\n{mit-notice}\n\n{mit-as-is} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.",
    "BSD-3-Clause": HOLDER + "{bsd-grant}\n\n1. {bsd-source}\n\n2. {bsd-binary}\n\n3. {bsd-endorse}\n\nTHIS SOFTWARE IS PROVIDED AS IT IS.",
    "BSD-2-Clause": HOLDER + "{bsd-grant}\n\n(a) {bsd-source}\n\n(b) {bsd-binary}",
    "GPL-3.0": "{gpl-free}\n\n{gpl-hope} {gpl-see}\n\nYou should have received a copy.",
    "GPL-2.0": "{gpl2-free}\n\n{gpl-hope} {gpl-see}",
    "ISC": HOLDER + "{isc-grant}\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.",
    "MPL-2.0": "{mpl2} If a copy of the MPL was not distributed with this file, You can obtain one.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); {apache-use} {apache-copy}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{apache-basis} {apache-see}",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_published_texts(spark, tmp_path, mark):
    import textwrap

    rows, want = [], {}
    for name, text in WHOLE.items():
        whole = re.sub(r"\{([\w-]+)\}", lambda m: Q.SENTENCES[m[1]][0], text)
        wrapped = "\n\n".join(textwrap.fill(p.strip(), 72, initial_indent="    " if p.startswith(" ") else "", break_long_words=False, break_on_hyphens=False) for p in whole.split("\n\n"))
        for t in (wrapped, " ".join(whole.split())):
            want[len(rows)] = [name]
            rows.append((len(rows), "Some words before\n\n" + "\n".join((mark + x).rstrip() for x in t.split("\n")) + "\n\nand after."))
    got = {r["doc_id"]: r for r in Q.licenses(documents(spark, tmp_path, rows)).collect()}
    assert {d: r["licenses"] for d, r in got.items()} == want
    assert all(m["rule"] in ("text", "notice") for r in got.values() for m in r["matches"])


def all_matches(rules, gap, ids, number):
    """Every choice of positions for every rule; of those that end first, the ones in no longer one."""
    import itertools

    got = []
    for r in rules:
        for k in range(len(ids)):
            ends = [c for c in itertools.combinations(range(k, len(ids)), len(r.sentences)) if c[0] == k and all(ids[j] == w for j, w in zip(c, r.sentences)) and all(number[b] - number[a] <= gap + 1 for a, b in zip(c, c[1:]))]
            if ends:
                got.append((number[k], -len(r.sentences), min(number[c[-1]] for c in ends), r))
    out, reach = [], -1
    for first, _, last, r in sorted(got, key=lambda g: g[:3]):
        if last > reach:
            out.append((r.license, r.name, first, last))
            reach = last
    return out


def test_rule_matching_against_all_choices():
    import random

    r = random.Random(4)
    rules = (Q.Rule("A", "1", ("x", "y", "z")), Q.Rule("B", "1", ("x", "z")), Q.Rule("C", "1", ("y",)), Q.Rule("D", "1", ("z", "y", "y", "x")))
    book = Q.Book({"x": ["one two"], "y": ["three four"], "z": ["five six"]}, rules, 1)
    for _ in range(500):
        number = sorted(r.sample(range(16), r.randint(0, 8)))
        ids = [r.choice("xyz") for _ in number]
        assert book.match(ids, number) == all_matches(rules, 1, ids, number)


@pytest.mark.parametrize("width", [60, 80])
def test_wrapped_at_other_widths(spark, tmp_path, width):
    import textwrap

    rows = []
    for name, text in WHOLE.items():
        whole = re.sub(r"\{([\w-]+)\}", lambda m: Q.SENTENCES[m[1]][0], text)
        rows.append((len(rows), "\n\n".join(textwrap.fill(p.strip(), width, break_long_words=False, break_on_hyphens=False) for p in whole.split("\n\n"))))
    got = {x["doc_id"]: x["licenses"] for x in Q.licenses(documents(spark, tmp_path, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == [[n] for n in WHOLE]
