"""Exact n-gram Jaccard self-join: a size-aware heavy-light join over shingle sets.

Two documents link when ``100 * intersection >= percent * union``.  The steps:

1. One scan turns texts into sets of 64-bit shingle hashes.  Each set's tokens,
   truncated and delta-coded in sorted order, go to token ranges as compact
   blobs (3 to 4 bytes a shingle).  Within a chunk of rows equal sets are sent once.
2. In each token range, tokens that only one set holds are dropped.  The others
   return to their chunk with their document frequency.  Of a token that ``HOT`` sets of
   a chunk hold only their number is sent, so a token of all documents is a row a chunk.
3. A set of n tokens can only link if at least ``ceil(t*n)`` of its tokens are
   shared, so most sets end here.  The others keep a *prefix*, their
   ``n - ceil(t*n) + 2`` rarest tokens less the unshared ones: any two linked
   sets have two tokens of it in common.
4. Equal sets form a class.  Classes with a short prefix (light) enumerate all
   2-subsets of it; those with a long one (heavy) are found through the inverted
   lists of single tokens, which hold light classes too.  The boundary between
   light and heavy is the one of least cost, from a histogram of prefix sizes.
5. A subset or list doesn't emit pairs: each member is tied to a leader of its
   size band, leaders of neighbouring bands to one another.  The connected
   components of these ties hold all pairs that may link.
6. The whole sets of a component (cut into bounded blocks, if it is large) meet
   in one task, which intersects them exactly as sparse and dense matrix products
   and returns only link counts and a spanning forest.

The truncation of tokens (step 1) may only add candidates; linking is decided on
64-bit hashes of whole shingles.

Nulls: a null text is an empty set, linked with nothing; a null doc_id is kept as
it is and never smaller than another.  Rows that repeat a doc_id count as separate
documents.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, labels
from .textbytes import U, mix, pieces, shingle_sets
from .work import Scratch, numbered, table, tidy

PERCENT = 70
CHUNK_TOKENS = 1 << 21
CHUNK_DOCS = 1 << 16
#: Sets of a chunk from which on a token of theirs is counted before it is sent.
HOT = 64
#: Tokens and classes of a verification block.
BLOCK_TOKENS, BLOCK_CLASSES = 400_000, 1024
#: Candidate rows up to this many are selected by a broadcast list of 8 bytes each; beyond it by a shuffled join.
LISTED = 2_000_000
SUBSET = 2


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -((-percent * n) // 100)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned values, as byte planes (the caller compresses them)."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, count).T
    return out.reshape(-1).view("<u8")


class _Plan:
    """Bits of a truncated token, and token ranges, for an input of so many bytes."""

    def __init__(self, size: int):
        scale = max(16, int(size).bit_length())
        self.bits = min(56, max(32, scale + 8))
        self.bucket_bits = min(20, max(4, scale - 21))
        self.low_bits = self.bits - self.bucket_bits
        self.width = (self.low_bits + 7) // 8
        self.chunk = max(CHUNK_TOKENS, 32 << self.bucket_bits)


EXCHANGE = "chunk long, bucket int, n int, data binary, docs binary"


def _class_of(s: np.ndarray) -> bytes:
    return np.array([mix(s + U(0x51)).sum(), mix(s ^ U(0x2545F4914F6CDD1D)).sum()], np.uint64).tobytes() if len(s) else b""


def _scan(plan: _Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, press, serial = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1), 0
        names = ["chunk", "bucket", "n", "data", "docs"]
        tokens: list[np.ndarray] = []
        rows: list[list] = [[], [], [], []]  # doc_id, uid, n, class
        first: dict[bytes, int] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tokens, rows, first, held, serial
            if not rows[0]:
                return
            chunk = (part << 24) | serial
            serial += 1
            docs = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], ["doc_id", "uid", "n", "cls"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as w:
                w.write_batch(docs)
            n_rows = len(rows[0])
            # sorted in place, and each array replaced as soon as it is done with: a chunk is held about three times at most
            key = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            idx = np.repeat(np.array(list(first.values()), np.uint16), [len(t) for t in tokens]) if tokens else np.zeros(0, np.uint16)
            tokens, rows, first, held = [], [[], [], [], []], {}, 0
            key >>= U(64 - plan.bits)
            if plan.bits <= 48:
                key <<= U(16)
                key |= idx
                key.sort()
                idx = key.astype(np.uint16)
                key >>= U(16)
            else:
                order = np.argsort(key, kind="stable")
                key, idx = key[order], idx[order]
                del order
            # tokens of many sets of the chunk: their sets stay with it, and only their number goes to the token range
            last = key[HOT - 1 :]
            hot_key = np.unique(last[last == key[: len(last)]])
            del last
            lo, hi = np.searchsorted(key, hot_key), np.searchsorted(key, hot_key, "right")
            edge = np.zeros(len(key) + 1, np.int8)
            edge[lo] += 1
            edge[hi] -= 1
            of_hot = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            hot_count = (hi - lo).astype(np.uint64)
            side = pack(hot_key, 8) + pack(hot_count, 3) + pack(idx[of_hot], 2)
            if len(hot_key):
                key, idx = key[~of_hot], idx[~of_hot]
            out = [[chunk], [-1], [n_rows], [struct.pack("<Q", len(hot_key)) + press.compress(side)], [press.compress(sink.getvalue().to_pybytes())]]
            for mine, value, width, mark in ((key, idx, 2, None), (hot_key, hot_count, 3, b"hot")):
                cut = np.searchsorted(mine, np.arange((1 << plan.bucket_bits) + 1, dtype=np.uint64) << U(plan.low_bits))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    t, d = mine[cut[b] : cut[b + 1]] & U((1 << plan.low_bits) - 1), value[cut[b] : cut[b + 1]]
                    gap = np.diff(t, prepend=U(0))
                    for column, v in zip(out, (chunk, b, len(t), press.compress(pack(gap, plan.width) + pack(d, width)), mark)):
                        column.append(v)
                    if len(out[0]) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names)
                        out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            ids, uids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, data, off in pieces(batch.column(2)):
                for k, s in enumerate(shingle_sets(data, off), a):
                    c = _class_of(s)
                    if len(s) and c not in first:
                        first[c] = len(rows[0])
                        tokens.append(s)
                        held += len(s)
                    for column, v in zip(rows, (ids[k], uids[k], len(s), c)):
                        column.append(v)
                    if held >= plan.chunk or len(rows[0]) >= CHUNK_DOCS:
                        yield from flush()
        yield from flush()

    return run


def _shared(plan: _Plan):
    """Per token range: tokens of two sets or more go back to their chunks, with their frequency."""

    def settle(bucket: int, blobs: list[tuple[int, int, bytes, bytes | None]]) -> tuple[list, list, list, list, list]:
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        keys, values = [], []
        for _, n, data, hot in blobs:
            raw = memoryview(unpress.decompress(data))
            keys.append(np.cumsum(unpack(raw[: n * plan.width], n, plan.width)))
            values.append(unpack(raw[n * plan.width :], n, 3 if hot else 2))
        key = np.concatenate(keys)
        weight = np.concatenate([v.astype(np.int64) if b[3] else np.ones(len(v), np.int64) for v, b in zip(values, blobs)])
        order = np.argsort(key, kind="stable")
        s = key[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        df = np.empty(len(key), np.int64)
        df[order] = np.repeat(np.add.reduceat(weight[order], start), np.diff(np.append(start, len(s))))
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        at = 0
        for (chunk, n, _, hot), k, d in zip(blobs, keys, values):
            f = df[at : at + n]
            at += n
            keep = f > 1
            m = int(keep.sum())
            if m:
                data = pack(np.diff(k[keep], prepend=U(0)), plan.width) + (b"" if hot else pack(d[keep], 2)) + pack(np.minimum(f[keep], 0xFFFFFF), 3)
                for column, v in zip(out, (chunk, bucket, m, press.compress(data), hot)):
                    column.append(v)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        now, blobs = -1, []
        for batch in batches:
            for chunk, bucket, n, data, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if blobs:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(settle(now, blobs), kinds)], batch.schema.names)
                    now, blobs = bucket, []
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((chunk, bucket, n, data, docs), kinds)], batch.schema.names)
                else:
                    blobs.append((chunk, n, data, docs))
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(settle(now, blobs), kinds)], ["chunk", "bucket", "n", "data", "docs"])

    return run


DOCS = "doc_id long, uid long, n long, cls binary, prefix binary, scan long"


def _prefixes(plan: _Plan, percent: int):
    """Per chunk: the prefix of each set that may link; null for the others and for repeats of a set."""

    def settle(docs: bytes, n: int, side: bytes, blobs: list[tuple[int, int, bytes, bytes | None]]) -> pa.RecordBatch:
        unpress = zstandard.ZstdDecompressor()
        light = pa.ipc.open_stream(unpress.decompress(docs)).read_next_batch()
        size = light.column(2).to_numpy()
        prefix: list[bytes | None] = [None] * n
        scan = np.zeros(n, np.int64)
        if blobs:
            key, idx, df = [], [], []
            n_hot = struct.unpack_from("<Q", side)[0]
            raw = memoryview(unpress.decompress(side[8:]))
            hot_key, hot_count = unpack(raw[: 8 * n_hot], n_hot, 8), unpack(raw[8 * n_hot : 11 * n_hot], n_hot, 3).astype(np.int64)
            hot_df = np.zeros(n_hot, np.int32)
            for bucket, m, data, hot in blobs:
                raw_, w = memoryview(unpress.decompress(data)), plan.width
                k = np.cumsum(unpack(raw_[: m * w], m, w)) | (U(bucket) << U(plan.low_bits))
                if hot:
                    hot_df[np.searchsorted(hot_key, k)] = unpack(raw_[m * w :], m, 3)
                else:
                    key.append(k)
                    idx.append(unpack(raw_[m * w : m * (w + 2)], m, 2).astype(np.uint16))
                    df.append(unpack(raw_[m * (w + 2) :], m, 3).astype(np.int32))
            key.append(np.repeat(hot_key, hot_count))
            idx.append(unpack(raw[11 * n_hot :], int(hot_count.sum()), 2).astype(np.uint16))
            df.append(np.repeat(hot_df, hot_count))
            k, i, f = np.concatenate(key), np.concatenate(idx), np.concatenate(df)
            del key, idx, df
            take = np.bincount(i, minlength=n) - least_shared(size, percent) + SUBSET
            able = take >= SUBSET
            on = able[i]
            k, i, f = k[on], i[on], f[on]
            order = np.lexsort((k, f, i))
            k, i, f = k[order], i[order], f[order]
            del order
            at = np.searchsorted(i, np.arange(n + 1))
            for d in np.flatnonzero(able & (np.diff(at) > 0)).tolist():
                a, b = at[d], min(at[d + 1], at[d] + take[d])
                prefix[d] = k[a:b].astype("<u8").tobytes()
                scan[d] = int((f[a:b] - 1).sum())
        return pa.RecordBatch.from_arrays([*light.columns, pa.array(prefix, pa.binary()), pa.array(scan)], ["doc_id", "uid", "n", "cls", "prefix", "scan"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, blobs = None, None, []
        for batch in batches:
            for chunk, bucket, n, data, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:  # sorted first in its chunk
                    if head:
                        yield settle(*head, blobs)
                    now, head, blobs = chunk, (docs, n, data), []
                else:
                    assert chunk == now
                    blobs.append((bucket, n, data, docs))
        if head:
            yield settle(*head, blobs)

    return run


def boundary(classes: DataFrame) -> int:
    """The largest prefix that is still enumerated as subsets: the least total of subset rows, or list rows and a quarter of the list entries scanned."""
    size = F.length("prefix") / 8
    bins = classes.filter("prefix IS NOT NULL").groupBy(F.floor(F.log2(size) * 2).alias("bin")).agg(F.max(size).alias("most"), F.sum(size * (size - 1) / 2).alias("subsets"), F.sum(size + F.col("scan") / 4).alias("lists")).orderBy("bin").collect()
    best, at = math.inf, 0
    for k in range(len(bins) + 1):
        cost = sum(b["subsets"] for b in bins[:k]) + sum(b["lists"] for b in bins[k:])
        if cost < best:
            best, at = cost, int(bins[k - 1]["most"]) if k else 0
    return at


def _keys(light_most: int):
    """Rows (key, alone, heavy, n, cid): 2-subsets of light prefixes, and single tokens of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "alone", "heavy", "band", "cid"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple[np.ndarray, bool, bool, int, int]] = []
                for cid, band, data in zip(*(c.to_pylist() for c in part.columns)):
                    t = np.frombuffer(data, "<u8")
                    heavy = len(t) > light_most
                    out.append((mix(t + U(1)), True, heavy, band, cid))
                    if not heavy and len(t) > 1:
                        a, b = np.triu_indices(len(t), 1)
                        u = np.sort(t)
                        out.append((mix(mix(u[a]) * U(0xC2B2AE3D27D4EB4F) + u[b]), False, False, band, cid))
                if out:
                    reps = [len(o[0]) for o in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), *(pa.array(np.repeat([o[k] for o in out], reps), kind) for k, kind in ((1, pa.bool_()), (2, pa.bool_()), (3, pa.int32()), (4, pa.int64())))], names)

    return run


def _sets(wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0)
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(uid.to_numpy(), wanted)))
            for a, b, data, off in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(data, off)], pa.binary())], ["cid", "tokens"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    inter = np.zeros((m, m), np.int64)
    dense = df >= max(8, m // 16)
    column = np.cumsum(dense) - 1
    on = dense[at]
    x, c = who[on], column[at[on]]
    order = np.argsort(c, kind="stable")
    x, c = x[order], c[order]
    width = max(64, (1 << 22) // m)
    for lo in range(0, int(dense.sum()), width):
        a, b = np.searchsorted(c, [lo, lo + width])
        block = np.zeros((m, width), np.float32)
        block[x[a:b], c[a:b] - lo] = 1
        inter += (block @ block.T).astype(np.int64)  # at most ``width`` each, so exact
    sparse = ~dense & (df > 1)
    on = sparse[at]
    x, t = who[on], at[on]
    order = np.argsort(t, kind="stable")
    lists, start = x[order], np.searchsorted(t[order], np.arange(len(df) + 1))
    rows = np.searchsorted(x, np.arange(m + 1))
    for i in range(m):
        mine = t[rows[i] : rows[i + 1]]
        if len(mine):
            n = start[mine + 1] - start[mine]
            take = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            inter[i] += np.bincount(lists[take], minlength=m)
    return inter


def _verify(percent: int):
    def settle(rows: list[tuple]) -> tuple[list, list, list]:
        cid = np.array([r[1] for r in rows])
        size, side = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        inter = intersections(sets)
        link = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        np.fill_diagonal(link, False)
        if side.any():
            link &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(link))
        node, root = labels(cid[a], cid[b])
        # weights are integers of any size, so no floating-point product here
        some = np.flatnonzero(link.any(1))
        return [*cid[some].tolist(), *node.tolist()], [*(int(size[link[i]].sum()) for i in some), *[0] * len(node)], [*cid[some].tolist(), *root.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                c, s, r = settle(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(r, pa.int64())], ["cid", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    yield from done()
                    now, rows = row[0], []
                rows.append(row)
        yield from done()

    return run


def jaccard_groups(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, block_classes: int = BLOCK_CLASSES, light_most: int | None = None) -> DataFrame:
    """One row per document: doc_id, uid, n_shingles, n_similar, component_id, keep_uid (the row that represents its component)."""
    return _groups(spark, numbered(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "uid"), percent, block_tokens, block_classes, light_most)


def _groups(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS, block_classes: int = BLOCK_CLASSES, light_most: int | None = None) -> DataFrame:
    """docs: doc_id, uid, text."""
    tmp = Scratch(spark, "jaccard")
    plan = _Plan(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))  # noqa: SLF001
    sent = docs.select("doc_id", "uid", "text").mapInArrow(tidy(_scan(plan)), EXCHANGE)
    back = sent.repartition(F.col("bucket"), F.when(F.col("bucket") < 0, F.col("chunk"))).sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(_shared(plan)), EXCHANGE)
    rows = tmp.keep(back.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(tidy(_prefixes(plan, percent)), DOCS), "docs")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    classes = tmp.keep(
        rows.filter("n > 0").groupBy("cls").agg(F.min("uid").alias("cid"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"), first.alias("low"), F.max("prefix").alias("prefix"), F.max("scan").alias("scan")).withColumn("band", F.floor(F.log("n") / math.log(100 / percent)).cast("int")), "classes"
    )
    most = boundary(classes) if light_most is None else light_most
    lists = tmp.keep(classes.filter("prefix IS NOT NULL").select("cid", "band", "prefix").mapInArrow(tidy(_keys(most)), "key long, alone boolean, heavy boolean, band int, cid long"), "lists")
    bands = lists.groupBy("key", "alone", "band").agg(F.min("cid").alias("leader"), F.max("cid").alias("other"), F.max("heavy").alias("heavy"))
    whole = bands.groupBy("key", "alone").agg(F.max("heavy").alias("any_heavy"), F.min("leader").alias("low"), F.max("other").alias("high")).filter("low <> high AND (any_heavy OR NOT alone)")
    bands = tmp.keep(bands.join(whole.select("key", "alone"), ["key", "alone"]).select("key", "alone", "band", "leader"), "bands")
    members = lists.join(bands, ["key", "alone", "band"]).select(F.col("cid").alias("a"), F.col("leader").alias("b"))
    across = bands.join(bands.select("key", "alone", (F.col("band") - 1).alias("band"), F.col("leader").alias("next")), ["key", "alone", "band"]).select(F.col("leader").alias("a"), F.col("next").alias("b"))
    ties = tmp.keep(components(tmp, members.unionByName(across), "ties"), "comps")

    held = ties.join(classes, ties["node"] == classes["cid"]).select("cid", F.col("root").alias("comp"), "band", "n", "size")
    blocks = held.groupBy("comp", "band").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("members"))
    sums = blocks.groupBy("comp").agg(F.sum("tokens").alias("all_tokens"), F.sum("members").alias("all_members"))
    fits = (F.col("all_tokens") <= block_tokens) & (F.col("all_members") <= block_classes)
    blocks = blocks.join(sums, "comp").select("comp", "band", fits.alias("fits"), F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("members") / block_classes)).cast("int").alias("cuts"))
    near = blocks.select("comp", F.col("band").alias("near_band"), F.col("cuts").alias("near_cuts"))
    placed = held.join(blocks, ["comp", "band"])
    own = placed.filter("fits").select("cid", "size", F.xxhash64("comp").alias("group"), F.lit(0).alias("side"))
    cut = placed.filter("NOT fits").withColumn("cut", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"))
    cut = cut.join(near, "comp").filter("abs(near_band - band) <= 1").withColumn("near_cut", F.explode(F.sequence(F.lit(0), F.col("near_cuts") - 1)))
    mine, theirs = F.struct("band", "cut"), F.struct(F.col("near_band").alias("band"), F.col("near_cut").alias("cut"))
    cut = cut.select("cid", "size", F.xxhash64("comp", F.least(mine, theirs), F.greatest(mine, theirs)).alias("group"), F.when(mine < theirs, 1).when(mine > theirs, 2).otherwise(0).alias("side"))
    # a block's pairs with itself and with others are different groups; in the latter every row has a side
    tasks = tmp.keep(own.unionByName(cut).dropDuplicates(["cid", "group"]), "tasks")
    n = ties.count()
    wanted = np.sort(ties.select("node").toArrow().column(0).to_numpy()) if n <= LISTED else None
    source = docs.select("uid", "text")
    if wanted is None:
        source = source.join(ties.select(F.col("node").alias("uid")), "uid", "left_semi")
    sets = source.mapInArrow(tidy(_sets(wanted)), "cid long, tokens binary")
    checked = tmp.keep(tasks.join(sets, "cid").select("group", "cid", "size", "side", "tokens").repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_verify(percent)), "cid long, links long, root long"), "links")

    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(tmp, checked.select("cid", "root"), "links-of")
    found = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cls", "size", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    lows = found.groupBy("root").agg(F.min("low").alias("least"))
    found = tmp.keep(found.join(lows, "root").select("cls", (F.col("size") - 1 + F.col("links")).alias("n_similar"), F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keep_uid")), "found")
    out = rows.filter("n > 0").join(found, "cls").select("doc_id", "uid", F.col("n").alias("n_shingles"), F.col("n_similar").cast("long").alias("n_similar"), "component_id", "keep_uid")
    empty = rows.filter("n = 0").select("doc_id", "uid", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), F.col("uid").alias("keep_uid"))
    return out.unionByName(empty)


def near_dedup(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of linked documents, with all its columns."""
    docs = numbered(docs)
    kept = _groups(spark, docs.select(F.col(key).cast("long").alias("doc_id"), F.col("_sl_uid").alias("uid"), F.col(text).alias("text")), **options).filter("uid = keep_uid").select(F.col("uid").alias("_sl_uid"))
    return docs.join(kept, "_sl_uid", "left_semi").drop("_sl_uid")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id")


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE []::VARCHAR[] END) AS sh FROM w)),
n AS (SELECT d.doc_id, count(s.sh) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 70 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_similar, least(n.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = n.doc_id), n.doc_id)) AS component_id FROM n
"""
