"""Line deduplication against all earlier documents.

A line is the sequence of its words; lines without words are passed over.  A *block*
is a run of consecutive lines that a document has in common, in the same order, with an
earlier one (by doc_id), and that has ``min_words`` words or more.  Blocks are deleted
from the later document, wherever they stand and as often as they stand there.
A *passage* is a run of words that both have in common and that stands inside longer
lines: of 49 words or more it is always found, of 25 or more perhaps, and it is deleted
as far as it is the same in the first document that holds it.

1. Lines become 64-bit hashes, and so do *windows*: from each line on, and up to each
   line, the shortest run of lines that has ``min_words``.  Each line of a block is in a
   window inside the block, so the windows with an earlier document are the blocks, and no
   pair of documents need be aligned (an alignment in order would pass over crossed and
   repeated blocks).  Common short lines (a licence notice, a greeting) are in no such
   window unless they stand in a longer passage.
2. *Prints* are the hashes of runs of ``PRINT`` words that are least among ``PRINT``
   neighbours (winnowing), so two documents with a run of ``2 * PRINT - 1`` words in common
   have a print in common there, and those of a longer run cover it but for its ends.
3. For each window and print that several documents hold, the first of them is its holder
   (a pre-aggregated minimum; no group of holders is ever collected); it is marked in
   the others.  What moves grows with lines and words, never with the square of a group.
   The ends of marked passages are then grown word by word, along with the holder's words
   before and after the print.
4. Equal documents are one class before that, and only its first is looked at; the others
   are repeats of it as a whole.  The first document with a line is never a later one for
   it, so one copy of every line stays somewhere.

Nulls: a null text has no lines; a null doc_id comes last.  Of rows that repeat a doc_id
the first by file and row is the earlier.  Texts without a block are unchanged.  Empty
tables give empty results; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import BYTE_VALUE, SPACE, hash_spans, pieces, spans, sums
from .work import Scratch, numbered, table

MIN_WORDS = 20
PRINT = 25
LISTED = 2_000_000


Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """(hashes, starts, ends, rows' offsets) of the words."""
    s, e, at = spans(~SPACE[data], off)
    return hash_spans(sums(BYTE_VALUE[data]), s, e), s, e, at


def lines(data: np.ndarray, off: np.ndarray, of: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word counts, starts, ends, rows' offsets) of the lines that have words; ends don't count the newline."""
    word, s, e, at = of or words(data, off)
    if not len(s):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, np.zeros(len(off), np.int64)
    newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
    row = np.searchsorted(at, np.arange(len(s)), "right") - 1
    line = newline[s]
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(s))
    breaks = np.flatnonzero(data == 0x0A)
    lo = np.searchsorted(breaks, s[first])
    start = np.maximum(np.where(lo > 0, breaks[np.maximum(lo - 1, 0)] + 1 if len(breaks) else 0, 0), off[row[first]])
    hi = np.searchsorted(breaks, e[last - 1])
    end = np.minimum(np.where(hi < len(breaks), breaks[np.minimum(hi, max(0, len(breaks) - 1))] if len(breaks) else len(data), len(data)), off[row[first] + 1])
    return hash_spans(sums(word), first, last), last - first, start, end, np.searchsorted(first, at)


def blocks(a: list[int], b: list[int], weight: list[int], min_words: int) -> list[tuple[int, int]]:
    """The longest ranges [from, to) of b's lines that stand in a as they are, anywhere and however often, with enough words.
    ``overlaps`` marks the same lines against all earlier documents at once; this is for two of them."""
    where: dict[int, list[int]] = {}
    for x, h in enumerate(a):
        where.setdefault(h, []).append(x)
    found, before = set(), {}
    for y in range(len(b) + 1):
        now = {x: before.get(x - 1, y) for x in where.get(b[y], ())} if y < len(b) else {}
        found |= {(first, y) for x, first in before.items() if x + 1 not in now and sum(weight[first:y]) >= min_words}
        before = now
    return [r for r in sorted(found) if not any(q != r and q[0] <= r[0] and r[1] <= q[1] for q in found)]


def prints(word: np.ndarray, at: np.ndarray, width: int = PRINT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first words, rows' offsets) of the runs of ``width`` words that are least of any ``width`` neighbouring runs; none crosses a row."""
    m = len(word) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    h = hash_spans(sums(word), np.arange(m), np.arange(m) + width)
    # a row's last runs, which would cross its end, are the greatest of all
    first = np.arange(m)
    row_end = np.repeat(at[1:], np.diff(at))[:m]
    inside = first + width <= row_end
    value = np.where(inside, h, np.uint64(2**64 - 1))
    # least values of neighbourhoods [p, p + width), by doubling, and whose they are: the last of the least
    low, own, span = value, first, 1
    while span < width:
        step = min(span, width - span)
        v, o = low[step:], own[step:]
        better = v <= low[: len(v)]
        low, own = np.where(better, v, low[: len(v)]), np.where(better, o, own[: len(v)])
        span += step
    full = first[: len(own)] + 2 * width - 1 <= row_end[: len(own)]
    marks = np.zeros(m, bool)
    marks[own[full]] = True
    found = np.flatnonzero(marks)
    return h[found], found, np.searchsorted(found, at)


DOC_LINES = "doc_id long, uid long, no_id boolean, n int, hashes array<long>, weights array<int>, prints array<long>, places array<int>"


def _doc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in pieces(batch.column(3)):
            of = words(data, off)
            h, n, _, _, rows = lines(data, off, of)
            p, first, own = prints(of[0], of[3])
            first = first - np.repeat(of[3][:-1], np.diff(own))
            cut, cut2 = pa.array(rows.astype(np.int32)), pa.array(own.astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32))), pa.ListArray.from_arrays(cut2, pa.array(p.view(np.int64))), pa.ListArray.from_arrays(cut2, pa.array(first.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(np.diff(rows).astype(np.int32)), *lists], ["doc_id", "uid", "no_id", "n", "hashes", "weights", "prints", "places"])


WINDOWS = "uid long, ord struct<no_id: boolean, doc_id: long, uid: long>, h long, from int, to int"


def windows(hashes: np.ndarray, weights: np.ndarray, rows: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the shortest runs of lines that have ``min_words`` from each line on, and up to each line; none crosses a row."""
    words = np.concatenate([[0], np.cumsum(weights)])
    at = np.arange(len(hashes))
    row = np.searchsorted(rows, at, "right") - 1
    end = np.searchsorted(words, words[:-1] + min_words)
    start = np.searchsorted(words, words[1:] - min_words, "right") - 1
    on, back = end <= rows[row + 1], (words[1:] >= min_words) & (start >= rows[row])
    s, e = np.concatenate([at[on], start[back]]), np.concatenate([end[on], at[back] + 1])
    s, e = np.divmod(np.unique(s * (len(hashes) + 1) + e), len(hashes) + 1)
    return hash_spans(sums(hashes), s, e), s, e


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of lines, and prints: their first word, and -1 in place of an end."""
        for batch in batches:
            rows = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())])
            lists = [batch.column(k).flatten().to_numpy() for k in (3, 4, 5, 6)]
            h, s, e = windows(lists[0].view(np.uint64), lists[1].astype(np.int64), rows, min_words)
            row = np.searchsorted(rows, s, "right") - 1
            counts = pc.list_value_length(batch.column(5)).to_numpy()
            own = pa.array(np.concatenate([row, np.repeat(np.arange(batch.num_rows), counts)]))
            h = np.concatenate([h.view(np.int64), lists[2]])
            s, e = np.concatenate([s - rows[row], lists[3]]).astype(np.int32), np.concatenate([e - rows[row], np.full(len(lists[3]), -1)]).astype(np.int32)
            for lo in range(0, len(h), 200_000):
                j = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own[j]), batch.column(1).take(own[j]), pa.array(h[j]), pa.array(s[j]), pa.array(e[j])], ["uid", "ord", "h", "from", "to"])

    return run


PARTS = "uid long, parts array<struct<from: int, to: int, h: long, holder: long>>"
ENDS = "uid long, at int, after boolean, h long, holder long"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last print of each run of marked prints that touch."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for uid, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            marked = [(p["from"], p["h"], p["holder"]) for p in parts if p["to"] < 0]
            for k, (at, h, holder) in enumerate(marked):
                for after, other in ((False, marked[k - 1][0] if k else None), (True, marked[k + 1][0] if k + 1 < len(marked) else None)):
                    if other is None or abs(other - at) > PRINT:
                        for c, v in zip(out, (uid, at, after, h, holder)):
                            c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))], ["uid", "at", "after", "h", "holder"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each print that is asked of a text: the words before it, from the last to the first, and those after it, where it first stands."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        for a, b, data, off in pieces(batch.column(0)):
            word, _, _, at = words(data, off)
            p, first, own = prints(word, at)
            out: list[list] = [[], [], []]
            for k in range(b - a):
                mine = p[own[k] : own[k + 1]].view(np.int64)
                order = np.argsort(mine, kind="stable")
                asked = np.array(sorted(set(wanted[a + k])), np.int64)
                where = order[np.minimum(np.searchsorted(mine[order], asked), len(mine) - 1)] if len(mine) else order
                for h, j in zip(asked.tolist(), where.tolist()):
                    x = int(first[own[k] + j])
                    before, after = word[max(at[k], x - PRINT) : x][::-1], word[x + PRINT : min(at[k + 1], x + 2 * PRINT)]
                    for c, v in zip(out, (h, before.view(np.int64).tolist(), after.view(np.int64).tolist())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in out[1:])], ["h", "before", "following"])


def overlaps(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, passages: bool = True, tmp: Scratch | None = None) -> DataFrame:
    """docs: doc_id, uid, text.  Deletions: uid, parts (ranges of lines, and prints), grown (at, after, words: a print, and the words at its side in its holder)."""
    tmp = tmp or Scratch(spark, "lines")
    rows = docs.withColumn("no_id", F.col("doc_id").isNull())
    held = tmp.keep(rows.select("doc_id", "uid", "no_id", "text").mapInArrow(_doc_lines, DOC_LINES), "lines")
    order = F.struct("no_id", "doc_id", "uid")
    whole = F.expr("aggregate(weights, 0L, (s, x) -> s + x)")
    some = held.filter("n > 0").withColumn("cls", F.struct(F.xxhash64("hashes"), F.hash("hashes"), "n"))
    classes = some.groupBy("cls").agg(F.min(order).alias("first"))
    none = F.lit(None).cast("long")
    part = F.struct(F.lit(0).alias("from"), F.col("n").alias("to"), none.alias("h"), none.alias("holder"))
    repeats = some.join(classes, "cls").filter(F.col("uid") != F.col("first.uid")).filter(whole >= min_words).select("uid", F.array(part).alias("parts"))
    # copies that are too short to be deleted hold nothing that is long enough either
    single = tmp.keep(some.join(classes.select(F.col("first.uid").alias("uid")), "uid", "left_semi").select("uid", order.alias("ord"), "n", "hashes", "weights", *(["prints", "places"] if passages else (F.array().cast(f"array<{k}>").alias(c) for c, k in (("prints", "long"), ("places", "int"))))), "single")
    each = tmp.keep(single.mapInArrow(_windows(min_words), WINDOWS), "windows")
    first = each.groupBy("h").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).filter("low <> high").select("h", "low")
    shared = each.join(first, "h").filter("low < ord")
    part = F.struct("from", "to", F.when(F.col("to") < 0, F.col("h")).alias("h"), F.when(F.col("to") < 0, F.col("low.uid")).alias("holder"))
    found = tmp.keep(shared.groupBy("uid").agg(F.sort_array(F.collect_set(part)).alias("parts")), "found")
    ends = tmp.keep(found.mapInArrow(_ends, ENDS), "ends")
    asked = ends.groupBy("holder").agg(F.collect_set("h").alias("asked")).withColumnRenamed("holder", "uid")  # at most a holder's own prints
    told = docs.select("uid", "text").join(asked, "uid").select("text", "asked").mapInArrow(_contexts, "h long, before array<long>, following array<long>")
    grown = ends.join(told, "h").select("uid", F.struct("at", "after", F.when(F.col("after"), F.col("following")).otherwise(F.col("before")).alias("words")).alias("end"))
    grown = grown.groupBy("uid").agg(F.collect_list("end").alias("grown"))
    return tmp.keep(found.unionByName(repeats).join(grown, "uid", "left"), "deletions")


def cut(text: pa.Array, parts: list[list | None], grown: list[list | None]) -> tuple[pa.Array, list[int], list[int]]:
    """Texts without the marked lines (each with its newline) and passages (each with the white space after it), and how many lines and words went."""
    out: list[bytes] = []
    gone: tuple[list[int], list[int]] = ([], [])
    for a, b, data, off in pieces(text):
        word, s, e, at = of = words(data, off)
        _, _, start, end, rows = lines(data, off, of)
        raw = data.tobytes()
        for k in range(b - a):
            lo, hi, first, last = int(off[k]), int(off[k + 1]), int(at[k]), int(at[k + 1])
            spoken = [(p["from"], p["to"]) for p in parts[a + k] or [] if p["to"] >= 0]
            ranges = [(int(start[rows[k] + x]), min(int(end[rows[k] + y - 1]) + 1, hi)) for x, y in spoken]
            cover = [(first + p["from"], first + p["from"] + PRINT) for p in parts[a + k] or [] if p["to"] < 0]
            for g in grown[a + k] or []:
                x = first + g["at"] + (PRINT if g["after"] else -1)
                step, limit = (1, last) if g["after"] else (-1, first - 1)
                theirs, n = np.array(g["words"], np.int64).view(np.uint64), 0
                while n < len(theirs) and x + step * n != limit and word[x + step * n] == theirs[n]:
                    n += 1
                if n:
                    cover.append((x, x + n) if g["after"] else (x - n + 1, x + 1))
            whole: list[list[int]] = []
            for x, y in sorted(cover):
                if whole and x <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], y)
                else:
                    whole.append([x, y])
            # a range begins with a word and takes the white space after its last one, or, at the end, before its first one
            ranges += [(int(s[x]), int(s[y])) if y < last else (int(e[x - 1]) if x > first else lo, hi) for x, y in whole]
            kept, now, missing = [], lo, 0
            for x, y in sorted(ranges):
                if y > now:
                    x = max(x, now)
                    kept.append(raw[now:x])
                    missing += int(np.searchsorted(s, y) - np.searchsorted(s, x))
                    now = y
            kept.append(raw[now:hi])
            out.append(b"".join(kept))
            gone[0].append(len({n for x, y in spoken for n in range(x, y)}))
            gone[1].append(missing)
    return pa.array(out, pa.binary()).cast(text.type), *gone


def line_dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, passages: bool = True) -> DataFrame:
    """``docs`` with shared blocks (and, if asked for, passages) deleted from later documents' texts, and two new columns: deleted_lines and deleted_words."""
    columns = [c for c in docs.columns if c not in ("deleted_lines", "deleted_words")]
    at = columns.index("text")
    schema = docs.select(*columns).withColumn("deleted_lines", F.lit(0)).withColumn("deleted_words", F.lit(0)).schema
    rows = numbered(docs.select(*columns))
    deletions = overlaps(spark, rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_sl_uid").alias("uid"), "text"), min_words, passages)
    marked = deletions.select(F.col("uid").alias("_sl_uid"), F.col("parts").alias("_sl_parts"), F.col("grown").alias("_sl_grown"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = list(batch.columns[: len(columns)])
            new[at], n, w = cut(batch.column(at), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*new, pa.array(n, pa.int32()), pa.array(w, pa.int32())], [*columns, "deleted_lines", "deleted_words"])

    if deletions.count() <= LISTED:  # 8 bytes each: texts that stay as they are need not move
        listed = np.sort(deletions.select("uid").toArrow().column(0).to_numpy())

        def apart(inside: bool):
            def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    on = np.isin(batch.column(len(columns)).to_numpy(), listed)
                    yield batch.filter(pa.array(on if inside else ~on))

            return pick

        same = rows.mapInArrow(apart(False), rows.schema).drop("_sl_uid")
        rows = rows.mapInArrow(apart(True), rows.schema)
    else:
        same = rows.join(marked.select("_sl_uid"), "_sl_uid", "left_anti").drop("_sl_uid")
    changed = rows.join(marked, "_sl_uid").select(*columns, "_sl_parts", "_sl_grown").mapInArrow(run, schema)
    return changed.unionByName(same.withColumn("deleted_lines", F.lit(0)).withColumn("deleted_words", F.lit(0)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "deleted_lines", "deleted_words", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
