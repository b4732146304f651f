"""Token-id shards with a minimal-perfect-hash index.

``write_store`` range-partitions documents by doc_id, encodes whole texts, appends the
end id, and writes each partition as a shard: ``NNNNNNNN.ids`` holds the raw ids as
little-endian unsigned 16- or 32-bit integers, document after document, and
``NNNNNNNN.idx`` a minimal perfect hash of the shard's keys (doc_id, occurrence) with,
at each key's slot, a 32-bit fingerprint, the offset and the length.  A manifest holds
each shard's key range and its first position in the whole id stream.  ``Shard.find``
takes constant time once the hash's bits are read: a hash function or two, one record with
its fingerprint, one range of ids.  Neither file is read as a whole.

Encoding is the tokenizers library's.  The byte-level pre-tokenizer's pattern is
applied to a whole batch with NumPy over code-point classes, which are asked of the
library itself; each distinct pre-token is encoded once by the library and remembered
by a 64-bit hash.  Texts that hold code points from U+3000 or an added token's string,
or whose tokenizer isn't of this kind, go through the library as they are.

Nulls: a null text is empty (only the end id); a null doc_id sorts first.  Rows that
repeat a doc_id are separate documents, in order of their texts' hash, and numbered by
occurrence within a shard (very many of them may fill several shards).  Files are
written under another name and moved, so repeated tasks do no harm.  Empty tables give an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op06_counts import tokenizer_path
from .op09_toxicity import codepoints
from .textbytes import U, hash_spans, mix, pieces, sums
from .work import Scratch, numbered, table

END, MAGIC = 2, b"IDX1"
#: Bytes that are read at once, and of a gap that is read over; text bytes of a shard.
READ, GAP, SHARD_BYTES = 4 << 20, 4096, 256 << 20
NONE = np.uint64(0x8000000000000001)  # stands for a null doc_id in hashes


# -- minimal perfect hash ------------------------------------------------------


def key_hash(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    h = np.where(null, NONE, doc_id.astype(np.int64).view(np.uint64))
    return mix(mix(h + U(0x9E3779B97F4A7C15)) ^ (occurrence.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + null.astype(np.uint64)))


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first bit that it has to itself."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.rank, total = [], 0
        for _, bits in levels:
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64) + total
            self.rank.append(ones)
            total = int(ones[-1])
        self.size = total + len(rest)
        self.at = {int(h): total + k for k, h in enumerate(rest.tolist())}

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h + U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """Keys are distinct 64-bit hashes."""
        levels = []
        while len(h) and len(levels) < 32:
            size = (2 * len(h) + 63) // 64 * 64
            p = cls._place(h, len(levels), size)
            lone = np.bincount(p, minlength=size) == 1
            levels.append((size, np.packbits(lone, bitorder="little").view("<u8")))
            h = h[~lone[p]]
        return cls(levels, np.sort(h))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """A slot in range(size) for each hash; of hashes that aren't keys, any slot or -1."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for k, (size, bits) in enumerate(self.levels):
            p = self._place(h[todo], k, size)
            word, bit = bits[p >> 6], (p & 63).astype(np.uint64)
            on = (word >> bit) & U(1) == 1
            below = np.bitwise_count(word & ((U(1) << bit) - U(1)))
            out[todo[on]] = self.rank[k][p[on] >> 6] + below[on]
            todo = todo[~on]
            if not len(todo):
                break
        for i in todo.tolist():
            out[i] = self.at.get(int(h[i]), -1)
        return out


RECORD = np.dtype([("print", "<u4"), ("offset", "<u8"), ("length", "<u4")])


def index_bytes(h: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    mph = PerfectHash.build(h)
    rows = np.zeros(len(h), RECORD)
    at = mph.slots(h)
    rows["print"][at], rows["offset"][at], rows["length"][at] = (h >> U(32)).astype(np.uint32), offset, length
    head = struct.pack("<4sIII", MAGIC, len(mph.levels), len(mph.rest), len(h)) + b"".join(struct.pack("<Q", size) for size, _ in mph.levels)
    return head + b"".join(bits.tobytes() for _, bits in mph.levels) + mph.rest.astype("<u8").tobytes() + rows.tobytes()


class Shard:
    """Keyed access to one shard, by ranges of its two files: the hash's bits, the records that are asked for, the ids that they name."""

    def __init__(self, index: pa.NativeFile, ids: pa.NativeFile, width: int):
        self.index, self.data, self.width = index, ids, width
        magic, n_levels, n_rest, self.n = struct.unpack("<4sIII", index.read_at(16, 0))
        if magic != MAGIC:
            raise ValueError("not an index of this format")
        at = 16 + 8 * n_levels
        sizes = struct.unpack(f"<{n_levels}Q", index.read_at(8 * n_levels, 16)) if n_levels else ()
        bits = index.read_at(sum(sizes) // 8, at)  # some 4 bits a key
        levels, k = [], 0
        for size in sizes:
            levels.append((size, np.frombuffer(bits, "<u8", size // 64, k)))
            k += size // 8
        self.mph = PerfectHash(levels, np.frombuffer(index.read_at(8 * n_rest, at + k), "<u8"))
        self.at = at + k + 8 * n_rest

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) of each key; offset -1 where it isn't here (but for one in 2**32)."""
        slot = self.mph.slots(h)
        r = np.zeros(len(h), RECORD)
        for some, raw in _spans(self.index, self.at + slot * RECORD.itemsize, np.where(slot < 0, 0, RECORD.itemsize)):
            r[some] = np.frombuffer(raw, RECORD)
        ok = (slot >= 0) & (r["print"] == (h >> U(32)).astype(np.uint32))
        return np.where(ok, r["offset"].astype(np.int64), -1), np.where(ok, r["length"], 0)

    def ids(self, offset: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of found keys, in any order."""
        kind = "<u2" if self.width == 2 else "<u4"
        n = np.where(offset < 0, 0, length).astype(np.int64)
        for some, raw in _spans(self.data, offset * self.width, n * self.width):
            got, at = np.frombuffer(raw, kind), 0
            for i in some.tolist():
                yield i, got[at : at + n[i]]
                at += n[i]
        for i in np.flatnonzero(n == 0).tolist():
            yield i, np.zeros(0, kind)


def _spans(file: pa.NativeFile, at: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
    """(rows, their bytes one after the other): neighbouring ranges are read at once, up to ``READ`` bytes with small gaps."""
    order = np.argsort(at, kind="stable")
    order = order[n[order] > 0]
    lo = 0
    while lo < len(order):
        first, hi, end = int(at[order[lo]]), lo + 1, int(at[order[lo]] + n[order[lo]])
        while hi < len(order) and at[order[hi]] - end <= GAP and at[order[hi]] + n[order[hi]] - first <= READ:
            end = max(end, int(at[order[hi]] + n[order[hi]]))
            hi += 1
        raw = file.read_at(end - first, first)
        yield order[lo:hi], b"".join(raw[int(at[i]) - first : int(at[i] + n[i]) - first] for i in order[lo:hi].tolist())
        lo = hi


# -- encoding -------------------------------------------------------------------


class Encoder:
    """Ids of many texts at a time, as the tokenizers library gives them with ``add_special_tokens=False``."""

    FAR = 0x3000

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.size = self.tok.get_vocab_size()
        if self.plain:
            one = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s)) == 1
            self.kind = np.zeros(self.FAR, np.uint8)  # 1 letter, 2 number, 3 other, 4 space, 5 other white space
            for cp in range(self.FAR):
                c = chr(cp)
                self.kind[cp] = 1 if one("a" + c) else 2 if one("1" + c) else 3 if one("!" + c) else 4 if c == " " else 5
        self._forget()

    def _forget(self) -> None:
        self.key, self.where, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _starts(self, cps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of one kind, a single space going with what follows, contractions apart."""
        n = len(cps)
        kind = self.kind[cps]
        white = kind >= 4
        row = np.zeros(n + 1, bool)
        row[at] = True
        before = np.concatenate([[0], kind[:-1]])
        before[row[:n]] = 0  # 0: the text's edge
        after = np.concatenate([kind[1:], [0]])
        after[row[1:]] = 0
        start = np.where(white, (before < 4) | ((after > 0) & (after < 4)), np.where(before == 4, False, kind != before))
        mark = np.flatnonzero((cps == 39) & (before != 3) & (before != 4))
        if len(mark):
            pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
            end = at[np.searchsorted(at, mark, "right")]
            a, b = pad[mark + 1], pad[mark + 2]
            one = (mark + 1 < end) & np.isin(a, [ord(c) for c in "stmd"])
            two = (mark + 2 < end) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            for on, k in ((one, 2), (two & ~one, 3)):
                m = mark[on]
                start[m + 1] = False
                nxt = m + k
                nxt = nxt[nxt < n]
                start[nxt[(kind[nxt] < 4) | start[nxt]]] = True
        return start

    def _plain(self, cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each)."""
        if not len(cps):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        s = np.flatnonzero(self._starts(cps, at))
        e = np.append(s[1:], len(cps))
        h = hash_spans(sums((cps.astype(np.uint64) + U(77)) * U(0xD6E8FEB86659FD93) | U(1)), s, e)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.key) > self.most:
            self._forget()
        p = np.minimum(np.searchsorted(self.key, distinct), max(0, len(self.key) - 1))
        new = np.flatnonzero(self.key[p] != distinct) if len(self.key) else np.arange(len(distinct))
        if len(new):
            text = cps.tobytes().decode("utf-32-le")
            words = [text[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())]
            got = [x.ids for x in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            n = np.array([len(x) for x in got])
            where = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))])
            key, where, count = np.concatenate([self.key, distinct[new]]), np.concatenate([self.where, where]), np.concatenate([self.count, n])
            order = np.argsort(key)
            self.key, self.where, self.count = key[order], where[order], count[order]
            p = np.searchsorted(self.key, distinct)
        n = self.count[p][which]
        base = self.where[p][which]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(base - end + n, n) + np.arange(int(end[-1]))]
        total = np.concatenate([[0], end])
        return ids, np.diff(total[np.searchsorted(s, at)])

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of a piece, how many each has)."""
        n = len(off) - 1
        cps, at = codepoints(data, off)
        odd = np.zeros(n, bool)
        if not self.plain:
            odd[:] = True
        else:
            far = np.flatnonzero(cps >= self.FAR)
            odd[np.searchsorted(at, far, "right") - 1] = True
            raw = data.tobytes()
            for t in self.added:
                k = raw.find(t)
                while k >= 0:
                    odd[int(np.searchsorted(off, k, "right")) - 1] = True
                    k = raw.find(t, k + 1)
        if not odd.any():
            return self._plain(cps, at)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        for i in np.flatnonzero(odd).tolist():
            text = cps[at[i] : at[i + 1]].tobytes().decode("utf-32-le")
            out[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        rest = np.flatnonzero(~odd)
        if len(rest):
            part = np.concatenate([cps[at[i] : at[i + 1]] for i in rest.tolist()])
            ids, counts = self._plain(part, np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[rest])]))
            cut = np.concatenate([[0], np.cumsum(counts)])
            for k, i in enumerate(rest.tolist()):
                out[i] = ids[cut[k] : cut[k + 1]]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array([len(x) for x in out], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- files ------------------------------------------------------------------------


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _move_in(fs: pa.fs.FileSystem, path: str, data: bytes) -> None:
    attempt = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(attempt) as f:
        f.write(data)
    fs.move(attempt, path)


MANIFEST = "shard int, doc_id long, occurrence int, n_tokens long"


def _write(uri: str, tokenizer: str, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), None
        fs, root = _file_system(uri)
        path = f"{root}/{part:08d}"
        stream, attempt = None, f"{path}.ids.{TaskContext.get().taskAttemptId()}"
        keys: list[tuple[int | None, int]] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows and stream is None:
                encode, stream = encoder_of(tokenizer), fs.open_output_stream(attempt)
            ids = batch.column(0).to_pylist()
            for a, b, data, off in pieces(batch.column(1)):
                got, n = encode(data, off)
                where = np.cumsum(n)
                got = np.insert(got, where, end)
                stream.write(got.astype("<u2" if width == 2 else "<u4").tobytes())
                counts.append(n + 1)
                new = []
                for k in ids[a:b]:
                    keys.append((k, keys[-1][1] + 1 if keys and keys[-1][0] == k else 0))
                    new.append(keys[-1][1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), pa.array(ids[a:b], pa.int64()), pa.array(new, pa.int32()), pa.array(n + 1)], ["shard", "doc_id", "occurrence", "n_tokens"])
        if stream is not None:
            stream.close()
            fs.move(attempt, f"{path}.ids")
            n = np.concatenate(counts)
            null = np.array([k is None for k, _ in keys])
            h = key_hash(np.array([k or 0 for k, _ in keys], np.int64), null, np.array([o for _, o in keys]))
            _move_in(fs, f"{path}.idx", index_bytes(h, np.cumsum(n) - n, n))

    return run


class Store:
    """A written store: ``documents`` (shard, doc_id, occurrence, n_tokens) and ``shards`` (shard, n_docs, n_tokens, first_id, last_id, start)."""

    def __init__(self, uri: str, width: int, documents: DataFrame):
        self.uri, self.width, self.documents = uri, width, documents
        shards = documents.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
        self.shards = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(self) -> DataFrame:
        """(doc_id, occurrence, shard, offset, n_tokens, ids binary as stored): every document, by key, from the files."""
        return self.look_up(self.documents.select("shard", "doc_id", "occurrence"))

    def look_up(self, keys: DataFrame, digest: bool = False) -> DataFrame:
        """Keyed access: ``keys`` has shard, doc_id and occurrence.  Rows of keys that aren't there have offset -1."""
        uri, width = self.uri, self.width
        shape = "doc_id long, occurrence int, shard int, offset long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _file_system(uri)
            held, shard, files = None, None, []
            for batch in batches:
                number = batch.column(0).to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, int)
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if held != number[a]:
                        held, path = int(number[a]), f"{root}/{number[a]:08d}"
                        for f in files:
                            f.close()
                        files = [fs.open_input_file(f"{path}.idx"), fs.open_input_file(f"{path}.ids")]
                        shard = Shard(*files, width)
                    keys_ = batch.column(1).slice(a, b - a)
                    null = keys_.is_null().to_numpy(zero_copy_only=False)
                    h = key_hash(keys_.fill_null(0).to_numpy(), null, batch.column(2).slice(a, b - a).to_numpy())
                    offset, n = shard.find(h)
                    rows: list = [None] * (b - a)
                    for i, r in shard.ids(offset, n):
                        rows[i] = zlib.crc32(r.astype("<u4").tobytes()) if digest else r.tobytes()
                    what = pa.array(rows, pa.int64() if digest else pa.binary())
                    yield pa.RecordBatch.from_arrays([keys_, batch.column(2).slice(a, b - a), pa.array(number[a:b].astype(np.int32)), pa.array(offset), pa.array(n.astype(np.int64)), what], ["doc_id", "occurrence", "shard", "offset", "n_tokens", "ids_crc32" if digest else "ids"])

        return keys.select("shard", "doc_id", "occurrence").mapInArrow(run, shape)

    def route(self, keys: DataFrame) -> DataFrame:
        """shard, doc_id, occurrence of every document that has one of a table's doc_ids, null included; ids that aren't there have none."""
        known = keys.select(F.col("doc_id").cast("long").alias("key"))
        at = self.documents.join(known, F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")
        return at.select("shard", "doc_id", "occurrence").repartition("shard").sortWithinPartitions("shard")


def write_store(spark: SparkSession, docs: DataFrame, tokenizer: str, uri: str | None = None, end: int = END, shards: int | None = None) -> Store:
    """Encode and write every document; ``uri`` defaults to a folder under ``spark.checkpoint.dir``."""
    tmp = Scratch(spark, "tokens")
    if uri is None:
        uri = f"{tmp.path}/store"
    fs, root = _file_system(uri)
    fs.create_dir(root, recursive=True)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000_000, size // SHARD_BYTES))
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_sl_h", F.xxhash64("text")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_sl_h"), F.col("_sl_uid")]  # rows that repeat a doc_id may lie in several shards
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return Store(uri, width, tmp.keep(rows.mapInArrow(_write(uri, tokenizer, end, width), MANIFEST), "manifest"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_store(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    read = store.look_up(store.documents, digest=True)
    return read.join(store.shards.select("shard", "start"), "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")
