"""Toxicity by noisy-channel deobfuscation and a document classifier.

1. A character bigram model is counted over every letter pair of all documents.
2. Spans that look disguised (letters mixed with digits or symbols that stand for
   letters, a letter three times or more in a row, single letters spaced or dotted
   apart) become lattices: each run of one character may stand for one or more
   letters, once or doubled, or for nothing.  Viterbi decoding under the character
   model finds the likeliest word (exact over the lattice, many spans at a time).
3. The restored text of a document gives its set of 4- to 6-letter grams, with word
   edges.  The grams that speak most for label 1 (by G-squared over the training
   rows) feed a logistic regression on how dense each is in the text; its probability
   is the score.

Only rows with ``crc32(doc_id) % 5 <> 0`` are learned from, at most ``max_labelled``
of them (those of least hash).  Everything else covers all rows and whole texts.

Nulls: a null text scores as an empty one (the base rate); a null doc_id is scored
but never learned from; null labels are ignored; of several labels for a doc_id the
largest counts.  With no label 1, or none at all, every score is the (smoothed) base
rate.  Empty tables give empty results; other columns pass unchanged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import U, hash_spans, pieces, spans, sums
from .work import Scratch, table, tidy

#: Labelled rows that a model is fitted on, at most; grams that it uses, at most.
MAX_LABELLED, MAX_GRAMS = 12_000, 600
#: Bytes of text that are worked on at once (a longer document is on its own), and grams that a task holds before it sums them.
AT_ONCE, HELD = 1 << 18, 1_000_000
GRAMS = (4, 5, 6)
LETTERS = 60  # 0: none; 1-26: a-z without accents; 27-59: letters of other scripts, hashed

_STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "*": "aeiou"}
_APART = " .-_*·"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, symbol, apart = np.zeros(0x3000, np.uint8), np.zeros(0x3000, bool), np.zeros(0x3000, bool)
    for cp in range(0x3000):
        c = unicodedata.normalize("NFKD", chr(cp))[:1].lower()
        if "a" <= c <= "z" and chr(cp).isalpha():
            code[cp] = ord(c) - 96
        elif chr(cp).isalpha():
            code[cp] = 27 + (cp * 40503 >> 4) % 33
    for a, b in zip("ßæøþðł", "saotdl"):
        code[ord(a)] = code[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = ord(b) - 96
    symbol[[ord(c) for c in _STANDS_FOR]] = True
    apart[[ord(c) for c in _APART]] = True
    return code, symbol, apart


CODE, SYMBOL, APART = _tables()


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a piece and the rows' offsets among them."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    if len(cps) == lead[-1]:
        return cps, lead[off]
    rows = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4") for a, b in zip(off[:-1], off[1:])]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def classes(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes, and the code points clipped to the tables."""
    small = np.minimum(cps, 0x2FFF)
    code = CODE[small]
    far = cps >= 0x3000
    if far.any():
        x = cps[far]
        plain = (x < 0x3040) | ((x >= 0xFE10) & (x < 0xFF10)) | (x >= 0x1F000) & (x < 0x20000)
        code[far] = np.where(plain, 0, 27 + (x * np.uint32(40503) >> np.uint32(4)) % np.uint32(33))
    return code, small


# -- the character model ------------------------------------------------------


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS * LETTERS, np.int64)
    for batch in batches:
        for _, _, data, off in pieces(batch.column(0), AT_ONCE):
            cps, at = codepoints(data, off)
            c = np.insert(classes(cps)[0], at, 0).astype(np.int64)
            total += np.bincount(c[:-1] * LETTERS + c[1:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of each letter after each other; 0 is a word's edge.  Counted over all documents."""
    counts = np.ones((LETTERS, LETTERS)) * 0.1
    for r in docs.select(text).mapInArrow(tidy(_pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most LETTERS squared
        counts[r["pair"] // LETTERS, r["pair"] % LETTERS] += r["n"]
    counts[0, 0] = 0.1
    return (-np.log(counts / counts.sum(1, keepdims=True))).astype(np.float32)


# -- the lattice --------------------------------------------------------------

#: Options of each character class: (letter, how often, cost for a run of 1, of 2, of more).  Classes 60 and up are symbols.
_SYMBOLS = {c: LETTERS + k for k, c in enumerate(_STANDS_FOR)}
_OPTIONS: list[list[tuple[int, int, float, float, float]]] = [[] for _ in range(LETTERS + len(_SYMBOLS))]
for _a in range(1, LETTERS):
    _OPTIONS[_a] = [(_a, 1, 0.0, 2.5, 0.1), (_a, 2, np.inf, 0.0, 0.3)]
for _c, _k in _SYMBOLS.items():
    _OPTIONS[_k] = [(0, 0, 3.0, 2.0, 1.5)]
    for _i, _letter in enumerate(_STANDS_FOR[_c]):
        _w = (2.0 if _c == "*" else 0.5) + 0.2 * _i
        _OPTIONS[_k] += [(ord(_letter) - 96, 1, _w, _w + 2.0, _w + 2.0), (ord(_letter) - 96, 2, np.inf, _w + 0.5, _w + 3.0)]
_MOST = max(map(len, _OPTIONS))
_LETTER = np.array([[o[0] for o in x] + [0] * (_MOST - len(x)) for x in _OPTIONS])
_TIMES = np.array([[o[1] for o in x] + [1] * (_MOST - len(x)) for x in _OPTIONS])
_COST = np.array([[o[2:] for o in x] + [(np.inf,) * 3] * (_MOST - len(x)) for x in _OPTIONS], np.float32)
_SYMBOL_CLASS = np.zeros(0x3000, np.uint8)
for _c, _k in _SYMBOLS.items():
    _SYMBOL_CLASS[ord(_c)] = _k


def _runs(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of a span's runs and the runs' lengths (1, 2, 3 for more), without what only keeps letters apart."""
    span = span[span > 0]
    if not len(span):
        return span, span
    start = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
    return span[start], np.minimum(np.diff(np.append(start, len(span))), 3)


#: Lattices of more runs than LONG are cut where only one reading is possible; BLOCK runs are decoded with their back pointers held.
LONG, BLOCK = 64, 65_536


def _forward(cost: np.ndarray, kind: np.ndarray, length: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs after these runs (runs x lattices), and for each run and state where it came from and the option that it took."""
    most, n = kind.shape
    rows = np.arange(n)
    came, chose = np.zeros((most, n, LETTERS), np.uint8), np.full((most, n, LETTERS), -1, np.int8)
    for step in range(most):
        on = kind[step] > 0
        new = np.full_like(cost, np.inf)
        new[~on] = cost[~on]
        for o in range(_MOST):
            w = _COST[kind[step], o, np.maximum(length[step], 1) - 1]
            able = on & np.isfinite(w)
            if not able.any():
                continue
            r, letter, times = rows[able], _LETTER[kind[step][able], o], _TIMES[kind[step][able], o]
            none = times == 0
            if none.any():
                q = r[none]
                value = cost[q] + w[able][none][:, None]
                better = value < new[q]
                new[q] = np.where(better, value, new[q])
                came[step, q] = np.where(better, np.arange(LETTERS, dtype=np.uint8), came[step, q])
                chose[step, q] = np.where(better, np.int8(o), chose[step, q])
            some = ~none
            if some.any():
                q, e = r[some], letter[some]
                into = cost[q] + model[:, e].T
                back = into.argmin(1)
                value = into[np.arange(len(q)), back] + w[able][some] + np.where(times[some] == 2, model[e, e], 0)
                better = value < new[q, e]
                q, e, back, value = q[better], e[better], back[better], value[better]
                new[q, e], came[step, q, e], chose[step, q, e] = value, back, o
        cost = new - np.where(on, new.min(1), 0)[:, None]  # only differences count
    return cost, came, chose


def _decode(parts: list[tuple[np.ndarray, np.ndarray, int, int]], model: np.ndarray) -> list[np.ndarray]:
    """The likeliest letters of lattices (runs, lengths, letter before, letter after), many at a time."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(parts)
    order = sorted((i for i in range(len(parts)) if len(parts[i][0])), key=lambda i: len(parts[i][0]))
    at = 0
    while at < len(order):
        longest = len(parts[order[at]][0])
        room = max(1, min(1024, 200_000 // max(1, longest * 2)))
        group = [i for i in order[at : at + room] if len(parts[i][0]) <= 2 * longest]
        at += len(group)
        n, most = len(group), max(len(parts[i][0]) for i in group)
        kind, length = np.zeros((most, n), np.int64), np.zeros((most, n), np.int64)
        for k, i in enumerate(group):
            kind[: len(parts[i][0]), k], length[: len(parts[i][0]), k] = parts[i][:2]
        rows = np.arange(n)
        cost = np.full((n, LETTERS), np.inf, np.float32)
        cost[rows, [parts[i][2] for i in group]] = 0
        starts, held = [], None
        for lo in range(0, most, BLOCK):  # back pointers of the last block only; earlier ones are made again on the way back
            starts.append(cost)
            cost, *held = _forward(cost, kind[lo : lo + BLOCK], length[lo : lo + BLOCK], model)
        state = (cost + model[:, [parts[i][3] for i in group]].T).argmin(1)
        letters: list[list[int]] = [[] for _ in group]
        for b in range(len(starts) - 1, -1, -1):
            lo = b * BLOCK
            came, chose = held or _forward(starts[b], kind[lo : lo + BLOCK], length[lo : lo + BLOCK], model)[1:]
            held = None
            for step in range(len(came) - 1, -1, -1):
                o, on = chose[step, rows, state], kind[lo + step] > 0
                for k in np.flatnonzero(on & (o >= 0)).tolist():
                    letters[k] += [int(_LETTER[kind[lo + step, k], o[k]])] * int(_TIMES[kind[lo + step, k], o[k]])
                state = np.where(on, came[step, rows, state], state)
        for k, i in enumerate(group):
            out[i] = np.array(letters[k][::-1], np.uint8)
    return out


def viterbi(spans_: list[np.ndarray], model: np.ndarray) -> list[np.ndarray]:
    """The likeliest letters of each span of character classes, exact over each lattice.

    A letter that stands once has one reading, so a long lattice falls into independent parts
    there; equal parts are decoded once.
    """
    parts: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
    plan: list[list[int]] = []  # of each span: parts, and sure letters as negative numbers
    for span in spans_:
        kind, length = _runs(span)
        cuts = np.flatnonzero((kind < LETTERS) & (length == 1)).tolist() if len(kind) > LONG else []
        mine, lo, before = [], 0, 0
        for hi in [*cuts, len(kind)]:
            after = int(kind[hi]) if hi < len(kind) else 0
            if hi > lo:
                key = (kind[lo:hi].tobytes(), length[lo:hi].tobytes(), before, after)
                if key not in parts:
                    parts[key] = len(held)
                    held.append((kind[lo:hi], length[lo:hi], before, after))
                mine.append(parts[key])
            if after:
                mine.append(-after)
            lo, before = hi + 1, after
        plan.append(mine)
    done = _decode(held, model)
    return [np.concatenate([done[k] if k >= 0 else np.array([-k], np.uint8) for k in mine]) if mine else np.zeros(0, np.uint8) for mine in plan]


# -- restored text ------------------------------------------------------------


class Restorer:
    """Letter codes of whole documents with disguised spans decoded.  Each distinct span is decoded once a worker."""

    def __init__(self, model: np.ndarray, most: int = 400_000):
        self.model, self.most, self.known = model, most, {}

    def spans(self, cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letter codes, lattice classes, and starts and ends of the spans that look disguised."""
        code, small = classes(cps)
        symbol = SYMBOL[small]
        some = code > 0
        n = len(cps)
        ws = (small == 32) | ((small >= 9) & (small <= 13))
        s, e, _ = spans(~ws, at)
        letters, symbols = np.concatenate([[0], np.cumsum(some)]), np.concatenate([[0], np.cumsum(symbol)])
        twice = np.zeros(n, bool)
        if n > 2:
            twice[2:] = some[2:] & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])
        runs3 = np.concatenate([[0], np.cumsum(twice)])
        has = lambda p: p[e] - p[s]
        odd = (has(letters) > 0) & ((has(symbols) > 0) | (has(runs3) > 0))
        a, b, _ = spans(some | symbol, at)
        lone = (b - a) == 1
        if len(a) > 2:
            row = np.searchsorted(at, a, "right")
            joined = lone[1:] & lone[:-1] & (a[1:] - b[:-1] == 1) & APART[small[np.minimum(b[:-1], n - 1)]] & (row[1:] == row[:-1])
            x, y, _ = spans(joined, np.array([0, len(joined)]))
            keep = (y - x >= 2) & (letters[b[y]] - letters[a[x]] > 0)
            cs, ce = a[x[keep]], b[y[keep]]
            # a chain takes in the words that it touches, so that no character is read twice
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, cs, 1)
            np.add.at(cover, ce, -1)
            cover = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            odd &= cover[e] - cover[s] == 0
            s, e = np.concatenate([s[odd], cs]), np.concatenate([e[odd], ce])
        else:
            s, e = s[odd], e[odd]
        return code, np.where(some, code, np.where(symbol, _SYMBOL_CLASS[small], 0)), s, e

    def __call__(self, cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """(letter codes with a 0 before each row, rows' offsets in them, decoded spans as (row, start, letters))."""
        code, lattice, s, e = self.spans(cps, at)
        found: list[tuple[int, int, np.ndarray]] = []
        if len(s):
            h = hash_spans(sums(lattice.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(0x2545F491)), s, e)
            distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
            keys = distinct.tolist()
            new = [k for k, x in enumerate(keys) if x not in self.known]
            if new:
                if len(self.known) + len(new) > self.most:
                    self.known, new = {}, list(range(len(keys)))
                for k, letters in zip(new, viterbi([lattice[s[first[k]] : e[first[k]]] for k in new], self.model)):
                    self.known[keys[k]] = letters
            row = np.searchsorted(at, s, "right") - 1
            for r, start, k in zip(row.tolist(), s.tolist(), which.tolist()):
                found.append((r, start, self.known[keys[k]]))
            hidden = np.zeros(len(code) + 1, np.int64)
            np.add.at(hidden, s, 1)
            np.add.at(hidden, e, -1)
            code = np.where(np.cumsum(hidden[:-1]) > 0, 0, code)
        return np.insert(code, at[:-1], 0), at + np.arange(len(at)), found


def gram_codes(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams whose inner characters are letters, and where they start."""
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    zero = np.concatenate([[0], np.cumsum(c == 0)])
    at = np.flatnonzero(zero[n - 1 : n - 1 + m] == zero[1 : 1 + m])
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = (out << U(6)) | c[at + k].astype(np.uint64)
    return out, at


def _row_grams(restore: Restorer, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, rows) of the grams of a piece, for each stream and length."""
    cps, at = codepoints(data, off)
    c, rows, found = restore(cps, at)
    for n in GRAMS:
        g, where = gram_codes(c, n)
        yield g, np.searchsorted(rows, where, "right") - 1
    if found:
        parts = [np.concatenate([[0], x, [0]]) for _, _, x in found]
        c = np.concatenate(parts).astype(np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        row = np.array([r for r, _, _ in found])
        for n in GRAMS:
            g, where = gram_codes(c, n)
            yield g, row[np.searchsorted(edge, where, "right") - 1]


# -- learning -----------------------------------------------------------------


class Model:
    """Grams, their weights, and the bias of a logistic regression on their density."""

    def __init__(self, letters: np.ndarray, grams: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(grams)
        self.letters, self.grams, self.weights, self.bias = letters, grams[order], weights[order], bias

    def _prepare(self) -> None:
        self.restore = Restorer(self.letters)
        self.slot = np.zeros(1 << 16, bool)
        self.slot[self._hash(self.grams)] = True

    @staticmethod
    def _hash(g: np.ndarray) -> np.ndarray:
        return ((g * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int64)

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The grams of each row of a piece: rows, grams, and how dense they are there (0 to 2)."""
        if not hasattr(self, "restore"):
            self._prepare()
        found = []
        k = len(self.grams)
        total = np.zeros(len(off) - 1)
        if k:
            for g, row in _row_grams(self.restore, data, off):
                total += np.bincount(row, minlength=len(total))
                may = np.flatnonzero(self.slot[self._hash(g)])
                at = np.minimum(np.searchsorted(self.grams, g[may]), k - 1)
                sure = self.grams[at] == g[may]
                found.append(row[may[sure]] * k + at[sure])
        key, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        row, gram = np.divmod(key, max(1, k))
        return row, gram, np.minimum(2, np.log2(1 + n * 1500 / (total[row] + 500)))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for a, b, data, off in pieces(column, AT_ONCE):
            row, gram, x = self.hits(data, off)
            out[a:b] = self.bias + np.bincount(row, self.weights[gram] * x if len(row) else None, minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Newton steps with an L2 penalty on the weights (not on the bias)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * v[:, None].astype(x.dtype)).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, y) of at most ``max_labelled`` labelled rows outside the held-out fold; of equal texts one."""
    pick = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy(F.col("doc_id").cast("long").alias("_sl_id")).agg(F.max("toxic").cast("int").alias("y"))
    pick = pick.orderBy(F.xxhash64("_sl_id"), "_sl_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("_sl_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "_sl_id")
    return rows.select("text", "y", F.xxhash64("text").alias("h"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_grams: int = MAX_GRAMS) -> Model:
    """Learn the character model from all documents and the classifier from the training fold."""
    tmp = Scratch(spark, "toxicity")
    letters = character_model(docs)
    rows = tmp.keep(training_rows(docs, labels, max_labelled), "rows").dropDuplicates(["h"]).select("text", "y")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(letters)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def sum_up() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return g, *(np.bincount(at, np.concatenate([h[k] for h in held]), minlength=len(g)).astype(np.int64) for k in (1, 2))

        for batch in batches:
            y = batch.column(1).to_numpy() == 1
            for a, b, data, off in pieces(batch.column(0), AT_ONCE):
                code, row = (np.concatenate(v) for v in zip(*_row_grams(restore, data, off)))
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                if len(code):
                    new = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
                    label = y[a:b][row[new]]
                    held.append((code[new], label, ~label))
                if sum(len(h[0]) for h in held[1:]) > HELD:
                    held[:] = [sum_up()]
        if held:
            g, pos, neg = sum_up()
            for k in range(0, len(g), 50_000):
                j = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(g[j].view(np.int64)), pa.array(pos[j]), pa.array(neg[j])], ["g", "pos", "neg"])

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = total.get(1, 0), sum(v for k, v in total.items() if k != 1)
    base = float(np.log((p + 0.5) / (n + 0.5))) if p + n else 0.0
    none = Model(letters, np.zeros(0, np.uint64), np.zeros(0), min(base, -1e-6) if p <= n else base)
    if not p or not n:
        return none
    counts = rows.mapInArrow(tidy(grams), "g long, pos long, neg long").groupBy("g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = p / (p + n)
    gain = F.col("pos") * F.log(F.col("pos") / ((F.col("pos") + F.col("neg")) * rate)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / ((F.col("pos") + F.col("neg")) * (1 - rate)))).otherwise(0)
    top = counts.filter("pos >= 3").filter(F.col("pos") > (F.col("pos") + F.col("neg")) * rate).orderBy(gain.desc(), "g").limit(max_grams).collect()
    if not top:
        return none
    chosen = Model(letters, np.array([r["g"] for r in top], np.int64).view(np.uint64), np.zeros(len(top)), 0.0)

    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(chosen.grams)
        for batch in batches:
            for a, b, data, off in pieces(batch.column(0), AT_ONCE):
                x = np.zeros((b - a, k), np.float16)
                row, gram, dense = chosen.hits(data, off)
                x[row, gram] = dense
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a)], ["x", "y"])

    got = rows.mapInArrow(tidy(density), "x binary, y int").orderBy("y", "x").toArrow()  # at most max_labelled rows of 2 bytes a gram
    x = np.frombuffer(b"".join(got.column(0).to_pylist()), np.float16).reshape(got.num_rows, len(top))
    weights, bias = fit_logistic(x.astype(np.float32), (got.column(1).to_numpy() == 1).astype(float))
    return Model(letters, chosen.grams, weights, bias)


# -- operators ----------------------------------------------------------------


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """``docs`` with a score column (one of that name is replaced)."""
    docs = docs.drop(column)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at)))], [*batch.schema.names, column])

    return docs.mapInArrow(tidy(run), docs.select("*").withColumn(column, F.lit(0.0)).schema)


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = fit(spark, docs, labels, **options)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def restored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, start, written, restored) of each span that was decoded; start counts characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.letters)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, data, off in pieces(batch.column(1)):
                cps, at = codepoints(data, off)
                code, _, s, e = restore.spans(cps, at)
                ends = dict(zip(s.tolist(), e.tolist()))
                out: list[list] = [[], [], [], []]
                for row, start, letters in restore(cps, at)[2]:
                    word = "".join(chr(96 + x) if x < 27 else "?" for x in letters.tolist())
                    for c, v in zip(out, (ids[a + row], int(start - at[row]), cps[start : ends[start]].tobytes().decode("utf-32-le"), word)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "start", "written", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(tidy(run), "doc_id long, start long, written string, restored string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    out = docs.mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
