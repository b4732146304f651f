"""Token counts by a compiled finite-state tokenizer.

The vocabulary of a BPE model (sentencepiece, byte fallback) is compiled into a
deterministic transducer over characters whose transitions carry the number of tokens
they add.  After a prefix of a text, only the places where a further vocabulary piece
may have begun matter, with the last token that ends at each and the count up to it;
this is the state.  On the next character the last token of the longer prefix is the
one vocabulary piece that may follow the token before it, i.e. that merging the two
alone keeps apart.  States and transitions are made as they are first met and kept, as
regular-expression engines do, so compilation costs nothing for strings that never occur.

No piece holds a space mark after another character, so a text is cut before each run
of spaces into chunks, on which the transducer starts afresh.  A chunk's state map is
then the constant map to its end with a count, and the composition of a text's maps is
a prefix sum of counts (``scan``).  Chunks are hashed, and each distinct one runs once
a worker, all of a batch in step.

Chunks of more than ``LONG`` characters (texts without spaces) are cut into blocks that run
in step as well: each block's state map is known for one entry state, the one after the
``WARM`` characters before it.  Maps compose where a block's entry is the exit of the one
before; elsewhere the block runs again from the true state, once for each such state and
content, until the maps compose again.  Counts are prefix sums over blocks, and exact.

Counts equal the library's for whole texts without added special tokens; control
symbols' strings in a text are ordinary text to it.  Models that this doesn't hold for
(other types, normalisation, pieces with inner space marks, user-defined symbols) are
refused.  Nulls: a null text is empty (0 bytes, 0 tokens); a null doc_id passes.  Rows
that repeat a doc_id each have a row.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import BYTE_VALUE, U, hash_spans, pieces, sums
from .work import table

LIMIT = 4096
#: Characters of a chunk that is cut into blocks; of a block; those that are read before it; and blocks at a time.
LONG, BLOCK, WARM, GROUP = 4096, 512, 64, 4096
MARK = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    """A lazily determinised transducer from characters to token counts."""

    def __init__(self, scores: dict[str, float], most_states: int = 250_000):
        self.scores, self.most = scores, most_states
        self.longest = max(map(len, scores), default=1)
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: for each place where a piece may have begun, how far back it is, the last token before it, that prefix's count less the present one, and the text since.
        self.states: dict[tuple, int] = {((0, "", 0, ""),): 0}
        self.keys: list[tuple] = [((0, "", 0, ""),)]
        self.moves: dict[int, tuple[int, int]] = {}
        self.table = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.fresh = 0

    def apart(self, a: str, b: str) -> bool:
        """Whether merging a + b alone gives just the two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def merge(self, text: str) -> list[str]:
        """Plain BPE: of all neighbours whose union is a piece, the best score merges first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """(next state, tokens added) on a character."""
        key = self.keys[state]
        known = c in self.scores
        last, count, cost = c, 0, 0
        if known:
            for back, token, since, text in key:  # longest pieces first
                piece = text + c
                if piece in self.scores and self.apart(token, piece):
                    last, count = piece, since + 1
                    break
            else:
                raise AssertionError(f"no token ends at {c!r}")
            cost = count
        else:
            cost = len(c.encode())  # byte fallback
            last = c
        # counts are kept relative to the new end; texts are kept so that pieces can be looked up
        grown = [(back + 1, token, since - cost, text + c) for back, token, since, text in key if text + c in self.prefixes]
        new = (*grown, (0, last if known else "", 0, ""))
        at = self.states.get(new)
        if at is None:
            at = self.states[new] = len(self.keys)
            self.keys.append(new)
        return at, cost

    def advance(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many chunks at a time (a key: the state above the character's 21 bits)."""
        key = state << 21 | char
        have, to, add = self.table
        at = np.searchsorted(have, key)
        ok = at < len(have)
        ok[ok] = have[at[ok]] == key[ok]
        nxt, cost = np.empty_like(state), np.empty_like(state)
        nxt[ok], cost[ok] = to[at[ok]], add[at[ok]]
        if not ok.all():
            rest = np.flatnonzero(~ok)
            distinct, which = np.unique(key[rest], return_inverse=True)
            got = np.empty((len(distinct), 2), np.int64)
            for k, x in enumerate(distinct.tolist()):
                move = self.moves.get(x)
                if move is None:
                    move = self.moves[x] = self.step(x >> 21, chr(x & 0x1FFFFF))
                    self.fresh += 1
                got[k] = move
            nxt[rest], cost[rest] = got[which, 0], got[which, 1]
        return nxt, cost

    def settle(self) -> None:
        """Start over when there are too many states; bring new transitions into the sorted table, once there are enough of them."""
        if len(self.keys) > self.most:
            self.reset()
        self.absorb()

    def absorb(self) -> None:
        if self.fresh > max(2000, len(self.table[0]) // 4):
            keys = np.fromiter(self.moves, np.int64, len(self.moves))
            moves = np.array(list(self.moves.values()), np.int64).reshape(-1, 2)
            order = np.argsort(keys)
            self.table, self.fresh = (keys[order], moves[order, 0], moves[order, 1]), 0

    def counts(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each chunk."""
        self.settle()
        long = np.flatnonzero(end - start > LONG)
        if not len(long):
            return self.run(cps, start, end, np.zeros(len(start), np.int64))[0]
        out = np.zeros(len(start), np.int64)
        short = np.flatnonzero(end - start <= LONG)
        out[short] = self.run(cps, start[short], end[short], np.zeros(len(short), np.int64))[0]
        for i in long.tolist():
            out[i] = self.composed(cps[start[i] : end[i]])
        return out

    def composed(self, cps: np.ndarray) -> int:
        """Tokens of one long chunk, from the state maps of its blocks."""
        total, key = 0, self.keys[0]
        for lo in range(0, len(cps), GROUP * BLOCK):
            self.settle()
            if key not in self.states:
                self.states[key] = len(self.keys)
                self.keys.append(key)
            start = np.arange(lo, min(len(cps), lo + GROUP * BLOCK), BLOCK)
            end = np.append(start[1:], min(len(cps), lo + GROUP * BLOCK))
            entry = self.run(cps, np.maximum(start - WARM, 0), start, np.zeros(len(start), np.int64))[1]
            entry[0] = self.states[key]
            count, leave = self.run(cps, start, end, entry)
            known: dict[tuple[int, bytes], tuple[int, int]] = {}
            at = 0
            for b in np.flatnonzero(np.concatenate([[False], leave[:-1] != entry[1:]])).tolist():
                at = max(at, b)
                while at < len(start) and leave[at - 1] != entry[at]:  # until the maps compose again
                    same = (int(leave[at - 1]), cps[start[at] : end[at]].tobytes())
                    if same not in known:
                        n, to = self.run(cps, start[at : at + 1], end[at : at + 1], leave[at - 1 : at])
                        known[same] = int(n[0]), int(to[0])
                    entry[at] = leave[at - 1]
                    count[at], leave[at] = known[same]
                    at += 1
            total, key = total + int(count.sum()), self.keys[int(leave[-1])]
        return total

    def run(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, state at the end) of each span from its entry state, all spans in step."""
        total, leave = np.zeros(len(start), np.int64), entry.copy()
        order = np.argsort(start - end, kind="stable")  # longest first, so that those still running are a prefix
        s, e = start[order], end[order]
        state = entry[order]
        length = e - s
        running = len(s)
        for k in range(int(length[0]) if len(s) else 0):
            while length[running - 1] <= k:
                running -= 1
            if running <= 16:  # few spans are left: one after the other
                for i in range(running):
                    at = int(state[i])
                    for c in cps[s[i] + k : e[i]].tolist():
                        move = self.moves.get(at << 21 | c)
                        if move is None:
                            move = self.moves[at << 21 | c] = self.step(at, chr(c))
                            self.fresh += 1
                        at = move[0]
                        total[order[i]] += move[1]
                    state[i] = at
                break
            if k % 64 == 63:
                self.absorb()
            nxt, cost = self.advance(state[:running], cps[s[:running] + k].astype(np.int64))
            state[:running] = nxt
            total[order[:running]] += cost
        leave[order] = state
        return total, leave


def compile_model(path: str) -> Transducer:
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    t, n = m.trainer_spec, m.normalizer_spec
    scores = {p.piece: p.score for p in m.pieces if p.type == 1}
    inner = [p for p in scores if MARK in p.lstrip(MARK)]
    if t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or any(p.type in (4, 5) for p in m.pieces) or inner:
        raise ValueError("only plain BPE models with byte fallback can be compiled")
    return Transducer(scores)


def scan(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The counts of composed chunk maps at the rows' ends: differences of one prefix sum."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(total[rows])


class Counter:
    """Counts whole texts; each distinct chunk runs through the transducer once."""

    def __init__(self, path: str, most: int = 2_000_000):
        self.machine, self.most = compile_model(path), most
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks: each a run of spaces and what follows up to the next.  The first chunk of a text has one space put before it."""
        space = data == 0x20
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[off[:-1]] = True
        cut[-1] = True
        start = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
        return start, np.append(start[1:], len(data)), np.searchsorted(start, off)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if (data == 0xE2).any() and b"\xe2\x96\x81" in data.tobytes():
            rows = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(off[:-1], off[1:])]
            data, off = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        s, e, rows = self._chunks(data, off)
        if not len(s):
            return np.zeros(len(off) - 1, np.int64)
        first = np.zeros(len(s), np.uint64)
        first[rows[:-1][np.diff(off) > 0]] = 1
        h = hash_spans(sums(BYTE_VALUE[data]), s, e) ^ (first * U(0x9E3779B97F4A7C15))
        distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
        have, count = self.known
        where = np.minimum(np.searchsorted(have, distinct), max(0, len(have) - 1))
        ok = have[where] == distinct if len(have) else np.zeros(len(distinct), bool)
        out = np.empty(len(distinct), np.int64)
        out[ok] = count[where[ok]] if len(have) else 0
        new = np.flatnonzero(~ok)
        if len(new):
            texts = [(b" " if first[k] else b"") + data[s[k] : e[k]].tobytes() for k in at[new].tolist()]
            text = b"".join(texts).decode("utf-8", "replace").replace(" ", MARK)
            cps = np.frombuffer(text.encode("utf-32-le"), "<u4")
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(texts), np.uint8) & 0xC0) != 0x80)])
            edge = lead[np.concatenate([[0], np.cumsum([len(t) for t in texts])])]
            out[new] = self.machine.counts(cps, edge[:-1], edge[1:])
            if len(have) + len(new) > self.most:
                have, count = have[:0], count[:0]
            k, v = np.concatenate([have, distinct[new]]), np.concatenate([count, out[new]])
            order = np.argsort(k)
            self.known = (k[order], v[order])
        return scan(out[which], rows)


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The worker's counter, with what it compiled and counted in earlier tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(path)
        for batch in batches:
            size, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, data, off in pieces(batch.column(1)):
                size[a:b], n[a:b] = np.diff(off), count(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
