"""Mixing sources to target weights, in fixed-length blocks.

Each source's documents, in order of doc_id, are one stream of words, cut into
blocks of ``block`` words (the last may be shorter).  A source's target is its share
by weight of all words, at most ``most_passes`` times its size, the excess reshared by
weight.  Its *slots* are as many blocks as make up the target, pass after pass over
the stream; the last slot is cut, so that totals meet targets to the word.

Output shards hold ``shard_slots`` slots each.  How many of them come from each source
is a multinomial draw, each shard's from its own seed.  Independent draws miss the
sources' totals by about their roots, so what goes beyond a source's slots is given, in
order, to sources that lack some; no total is missed, at any size.  The slots that
earlier shards drew are prefix sums over strips of shards.  Slot k of a source is
block ``permutation(k mod blocks)`` of pass ``k div blocks``, a keyed pseudorandom
permutation per source and pass.  Slots and blocks are then joined by index.

Weights go 1, 2, 3, 1, ... to sources in code-point order, null last (or ``weights``).
Nulls: a null text has no words, a null source is a source of its own, a null doc_id
comes first in its stream.  Rows that repeat a doc_id are separate documents.  Texts
without words are never taken.  Empty tables give empty results.  The table of sources
(about 100 bytes each) is held by the driver and by each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textbytes import SPACE, count_words, pieces, spans
from .work import Scratch, local_table, numbered, table, tidy

BLOCK, SHARD_SLOTS, MOST_PASSES, SEED = 256, 4096, 3, 20240229
#: Shards that one task draws in a row.
STRIP = 16


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Shares by weight of the total, none above ``most`` times its size, the excess reshared by weight until none is."""
    out = [0.0] * len(sizes)
    open_, rest = [i for i in range(len(sizes)) if sizes[i] > 0], float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        over_ = set(over)
        open_ = [i for i in open_ if i not in over_]
    return out


def permutation(values: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), or its inverse: a Feistel network on the next power of four, walked until it falls in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(4)]

    def spread(y: np.ndarray, k: np.uint64) -> np.ndarray:
        f = (y + k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (f >> np.uint64(32)) & mask

    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, y = out[todo] >> np.uint64(half), out[todo] & mask
        for k in reversed(keys) if back else keys:
            x, y = (y ^ spread(x, k), x) if back else (y, x ^ spread(y, k))
        out[todo] = (x << np.uint64(half)) | y
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(seed: int, source: int, turn: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}/{source}/{turn}".encode(), digest_size=8).digest(), "little")


class Plan:
    """What each source gives: blocks, slots, and the words of its last slot."""

    def __init__(self, sizes: list[int], want: list[float], block: int, shard_slots: int, seed: int):
        self.block, self.shard_slots, self.seed = block, shard_slots, seed
        self.sizes = np.array(sizes, np.int64)
        self.blocks = -(-self.sizes // block)
        self.slots, self.last = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i, (size, t) in enumerate(zip(sizes, want)):
            t = min(int(round(t)), 10**18) if size else 0
            turns, rest = divmod(t, size) if size else (0, 0)
            short = int(self.blocks[i]) * block - size
            k = 0
            if rest:
                # where the source's last block, which may be short, comes in the last pass
                where = int(permutation(np.array([self.blocks[i] - 1]), int(self.blocks[i]), _key(seed, i, turns), back=True)[0])
                k = rest // block
                if k > where:  # the short block is among them
                    k = (rest + short) // block
                    if k <= where:
                        k = where + 1
                done = k * block - (short if k > where else 0)
                if done > rest:
                    k, done = k - 1, (k - 1) * block - (short if k - 1 > where else 0)
                self.last[i] = rest - done
                k += rest > done
            self.slots[i] = turns * int(self.blocks[i]) + k
        self.ends = np.cumsum(self.slots)
        self.total = int(self.ends[-1]) if len(sizes) else 0
        self.shards = -(-self.total // shard_slots)
        self.strips = -(-self.shards // STRIP)
        self.over = self.need = self.drawn = None

    def draw(self, shard: int) -> np.ndarray:
        """The sources of a shard's slots: a multinomial draw in proportion to the sources' slots."""
        n = min(self.shard_slots, self.total - shard * self.shard_slots)
        return np.searchsorted(self.ends, np.random.default_rng([self.seed, shard]).integers(0, self.total, n), "right")

    def of_strip(self, strip: int) -> range:
        return range(strip * STRIP, min(self.shards, (strip + 1) * STRIP))

    def counts(self, strip: int) -> tuple[np.ndarray, np.ndarray]:
        """(sources, slots drawn of each) of a strip of shards."""
        return np.unique(np.concatenate([self.draw(s) for s in self.of_strip(strip)]), return_counts=True)

    def settle(self, drawn: np.ndarray) -> None:
        """Takes the number of slots that all shards drew of each source.  Draws beyond a source's slots go to sources that lack some."""
        self.drawn = drawn
        over = np.maximum(drawn - self.slots, 0)
        self.over = np.cumsum(over) - over
        self.need = np.cumsum(np.maximum(self.slots - drawn, 0))

    def rows(self, shard: int, before: dict[int, int]) -> tuple[np.ndarray, ...]:
        """(slot in the shard, source, pass, block, words) of a shard's slots.  ``before``, slots drawn of each source so far, moves on."""
        source = self.draw(shard)
        order = np.argsort(source, kind="stable")
        found, first, n = np.unique(source[order], return_index=True, return_counts=True)
        base = np.array([before.get(s, 0) for s in found.tolist()], np.int64)
        k = np.empty(len(source), np.int64)
        k[order] = np.arange(len(source)) - np.repeat(first, n) + np.repeat(base, n)
        before.update(zip(found.tolist(), (base + n).tolist()))
        moved = np.flatnonzero(k >= self.slots[source])
        if len(moved):
            j = self.over[source[moved]] + k[moved] - self.slots[source[moved]]
            to = np.searchsorted(self.need, j, "right")
            source[moved], k[moved] = to, self.drawn[to] + j - np.where(to > 0, self.need[to - 1], 0)
        blocks = self.blocks[source]
        turn, block = k // blocks, k % blocks
        for s, t in np.unique(np.stack([source, turn], 1), axis=0).tolist():
            on = np.flatnonzero((source == s) & (turn == t))
            block[on] = permutation(block[on], int(self.blocks[s]), _key(self.seed, s, t))
        words = np.where(block == blocks - 1, self.sizes[source] - (blocks - 1) * self.block, self.block)
        words = np.where((k == self.slots[source] - 1) & (self.last[source] > 0), self.last[source], words)
        return np.arange(len(k)), source, turn, block, words


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for a, b, data, off in pieces(batch.column(3)):
            n[a:b] = count_words(data, off)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], ["doc_id", "uid", "source", "size"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums within a sorted partition, by source."""
    part, now, total = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        s, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if not len(s):
            continue
        first = np.concatenate([[s[0] != now], s[1:] != s[:-1]])
        cum = np.cumsum(n) - n
        base = np.where(first, cum, 0)
        base = base[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))] if first.any() else np.zeros_like(cum)
        head = np.cumsum(first) == 0
        start = cum - base + np.where(head, total, 0)
        total, now = int(start[-1] + n[-1]), int(s[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(start)], ["doc_id", "uid", "sidx", "size", "part", "start"])


class Mix:
    """The tables of a mix: ``sources``, ``docs`` (doc_id, uid, sidx, size, start), ``slots`` and ``taken`` (uid, turn, start, words)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, weights: Callable[[list[str | None]], list[float]] | None = None, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, most_passes: int = MOST_PASSES, name: str = "mix"):
        tmp = Scratch(spark, name)
        docs = docs if "_sl_uid" in docs.columns else numbered(docs.select("doc_id", "source", "text"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_sl_uid").alias("uid"), F.col("source").cast("string").alias("source"), "text")
        sized = tmp.keep(rows.select("doc_id", "uid", "source", "text").mapInArrow(tidy(_sizes), "doc_id long, uid long, source string, size long"), "sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # a row for each source
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        names, sizes = [r["source"] for r in found], [int(r["n"]) for r in found]
        weight = weights(names) if weights else [1 + i % 3 for i in range(len(names))]
        want = targets(sizes, weight, most_passes)
        self.plan = plan = Plan(sizes, want, block, shard_slots, seed)
        self.sources = local_table(spark, [(i, *x) for i, x in enumerate(zip(names, sizes, want))], "sidx int, name string, source_size long, target double")
        named = sized.join(self.sources.select("sidx", "name"), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "uid", "sidx", "size")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = named.repartitionByRange(parts, "sidx", "doc_id", "uid").sortWithinPartitions("sidx", "doc_id", "uid")
        run = tmp.keep(ordered.mapInArrow(tidy(_running), "doc_id long, uid long, sidx int, size long, part int, start long"), "runs")
        ends = run.groupBy("sidx", "part").agg(F.sum("size").alias("n"))  # at most partitions plus sources
        base = ends.withColumn("base", F.sum("n").over(Window.partitionBy("sidx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("sidx", "part", F.coalesce("base", F.lit(0)).alias("base"))
        self.docs = run.join(base, ["sidx", "part"]).select("doc_id", "uid", "sidx", "size", (F.col("start") + F.col("base")).alias("start"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for strip in batch.column(0).to_pylist():
                    source, n = plan.counts(strip)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), strip)), pa.array(source.astype(np.int32)), pa.array(n)], ["strip", "sidx", "n"])

        strips = spark.range(0, plan.strips, 1, max(1, min(plan.strips, parts)))
        drawn = tmp.keep(strips.mapInArrow(tidy(count), "strip long, sidx int, n long"), "drawn")
        total = np.zeros(len(names), np.int64)
        for r in drawn.groupBy("sidx").agg(F.sum("n").alias("n")).collect():  # a row for each source
            total[r["sidx"]] = r["n"]
        plan.settle(total)
        before = F.coalesce(F.sum("n").over(Window.partitionBy("sidx").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = drawn.withColumn("before", before).groupBy("strip").agg(F.collect_list(F.struct("sidx", "before")).alias("of"))  # at most the strip's slots

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for strip, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    before = {r["sidx"]: r["before"] for r in of}
                    for number in plan.of_strip(strip):
                        slot, source, turn, at, words = plan.rows(number, before)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), number)), pa.array(slot), *(pa.array(c.astype(np.int32)) for c in (source, turn)), pa.array(at), pa.array(words)], ["shard", "slot", "sidx", "turn", "block", "words"])

        self.slots = bases.mapInArrow(tidy(draw), "shard long, slot long, sidx int, turn int, block long, words long")
        span = self.docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        low = F.greatest(F.col("start"), F.col("block") * block)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        self.blocks = span.select("uid", "sidx", "block", "start", low.alias("low"), high.alias("high"))

    def taken(self) -> DataFrame:
        """(uid, words) that the mix takes of each document, repeats counted."""
        b = self.plan.block
        times = self.slots.groupBy("sidx", "block", "words").agg(F.count(F.lit(1)).alias("times")).hint("merge")  # the planner takes the slots for a table of a few rows
        got = F.greatest(F.lit(0), F.least(F.col("high"), F.col("block") * b + F.col("words")) - F.col("low"))
        return self.blocks.join(times, ["sidx", "block"]).groupBy("uid").agg(F.sum(got * F.col("times")).alias("taken"))

    def pieces(self) -> DataFrame:
        """(uid, turn, parts): for each document and pass, the word ranges [from, to) within the document that are taken, in order."""
        b = self.plan.block
        cut = self.blocks.join(self.slots.select("sidx", "turn", "block", "words").hint("merge"), ["sidx", "block"]).withColumn("to", F.least(F.col("high"), F.col("block") * b + F.col("words"))).filter("to > low")
        return cut.groupBy("uid", "turn").agg(F.sort_array(F.collect_list(F.struct((F.col("low") - F.col("start")).alias("from"), (F.col("to") - F.col("start")).alias("to")))).alias("parts"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each document and pass, with the words that are taken then (a whole text unchanged) and all columns of ``docs``."""
    columns, schema, docs = docs.columns, docs.schema, numbered(docs)
    mix = Mix(spark, docs, **options)
    joined = docs.join(mix.pieces().select(F.col("uid").alias("_sl_uid"), F.col("parts").alias("_sl_parts")), "_sl_uid").drop("_sl_uid")
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, parts = batch.column(at), batch.column(len(columns)).to_pylist()
            out: list[bytes] = []
            for a, _, data, off in pieces(text):
                s, e, rows = spans(~SPACE[data], off)
                for k in range(len(off) - 1):
                    first, n, keep = int(rows[k]), int(rows[k + 1] - rows[k]), []
                    for p in parts[a + k]:
                        if keep and keep[-1][1] == p["from"]:
                            keep[-1][1] = p["to"]
                        else:
                            keep.append([p["from"], p["to"]])
                    if keep == [[0, n]]:
                        out.append(data[off[k] : off[k + 1]].tobytes())
                    else:
                        out.append(b"\n".join(data[s[first + x] : e[first + y - 1]].tobytes() for x, y in keep))
            new = list(batch.columns[: len(columns)])
            new[at] = pa.array(out, pa.binary()).cast(text.type)
            yield pa.RecordBatch.from_arrays(new, columns)

    mixed = joined.select(*columns, "_sl_parts").mapInArrow(tidy(cut), schema)
    return mixed.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else mixed


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(spark, table(spark, sf_dir, "documents"))
    rows = mix.docs.join(mix.sources, "sidx").join(mix.taken(), "uid", "left")
    return rows.select("doc_id", F.col("name").alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
