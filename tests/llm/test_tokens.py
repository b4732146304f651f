import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import op03_tokenstore as S
from sparkloom.llm import op06_counts as C
from sparkloom.llm.textbytes import pieces
from sparkloom.llm.work import table

from .helpers import documents

TEXTS = [None, "", " ", "  ", "   the", "a  b   c    d", "don't we'll I'VE they're 'tis ''s 's", "x 's\n's\t'm ' s", "line\n\nline \n  next\r\n\ttab", "12345 1 22 abc123", "naïve café ñandú Straße", "日本語のテキスト", "emoji 🙂🙂 ok", "<|endoftext|> inside", "<s> </s> <unk> <0x41>", "▁mark▁▁here", "a b c　d", "\x00\x01 control \x7f", "!!! ... ,,, ((", " " * 70 + "end", "z" * 3000, "ab" * 2000, "\n" * 50, "'" * 9 + "s", "it's'd've", "é combining", "αβγ Дом שלום", "x" + " " * 33, "word " * 500]


def random_texts(n, seed):
    r = random.Random(seed)
    alphabet = ["a", "e", "the", "ing", "tion", " ", " ", "  ", "\n", "'", "'s", "'re", "é", "1", "23", ".", ",", "-", "x", "q", "é", "ß", "\t", "Z", "▁", "中", "🙂", "http", "://"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def _counted(texts):
    count = C.Counter(C.tokenizer_path("piece_bpe_32k.model"))
    out = []
    for _, _, data, off in pieces(pa.array(texts, pa.string())):
        out += count(data, off).tolist()
    return out


def test_counts_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=C.tokenizer_path("piece_bpe_32k.model"))
    texts = TEXTS + random_texts(3000, 4)
    want = [len(lib.encode(t or "")) for t in texts]
    assert _counted(texts) == want


def test_long_chunks_compose(monkeypatch):
    """Texts without spaces, in blocks, at every block size: the library's counts, and those of one run."""
    import sentencepiece

    r = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(r.choices(alphabet, k=9000)), "a" * 7001, "ab" * 3000 + "abc" * 2000, "".join(chr(r.randint(0x4E00, 0x5000)) for _ in range(6000)), "the" * 2500, "x" * 5000 + "the" * 900 + "=" * 4000]
    sp = sentencepiece.SentencePieceProcessor(model_file=C.tokenizer_path("piece_bpe_32k.model"))
    want = [len(sp.encode(t)) for t in texts]
    for block, warm, group in ((512, 64, 4096), (100, 0, 7), (64, 5, 3)):
        for name, v in (("LONG", 600), ("BLOCK", block), ("WARM", warm), ("GROUP", group)):
            monkeypatch.setattr(C, name, v)
        count = C.Counter(C.tokenizer_path("piece_bpe_32k.model"))
        got = [n for _, _, d, o in pieces(pa.array(texts)) for n in count(d, o).tolist()]
        assert got == want
    count.machine.most = 50  # states are made again between groups
    marked = ("▁" + texts[0]).encode("utf-32-le")
    assert count.machine.composed(np.frombuffer(marked, "<u4")) == want[0]


def test_counts_query(spark, tmp_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=C.tokenizer_path("piece_bpe_32k.model"))
    rows = table(spark, "/root/testdata/sf0.01", "documents").collect()
    got = {r["doc_id"]: r for r in C.op6_token_counts(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        n = len(lib.encode(r["text"]))
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(r["text"].encode()), n, n > 4096)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        C.compile_model(C.tokenizer_path("byte_bpe_50k.json"))


def test_perfect_hash():
    for n in (0, 1, 2, 50, 5000):
        h = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        mph = S.PerfectHash.build(h)
        assert sorted(mph.slots(h).tolist()) == list(range(len(h))) and mph.size == len(h)
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64))
    ids = np.arange(4000).astype("<u2")
    shard = S.Shard(pa.BufferReader(S.index_bytes(h[:2000], np.arange(2000) * 2, np.full(2000, 2))), pa.BufferReader(ids.tobytes()), 2)
    some = np.array([1999, 3, 700, 3])
    assert {i: r.tolist() for i, r in shard.ids(*shard.find(h[some]))} == {k: [2 * x, 2 * x + 1] for k, x in enumerate(some.tolist())}
    assert shard.find(h[:2000])[0].tolist() == (np.arange(2000) * 2).tolist()
    assert (shard.find(h[2000:])[0] >= 0).sum() <= 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    path = C.tokenizer_path(name)
    tok, encode = Tokenizer.from_file(path), S.Encoder(path)
    texts = TEXTS + random_texts(1500, 9)
    ids, n = [], []
    for _, _, data, off in pieces(pa.array(texts, pa.string())):
        i, k = encode(data, off)
        ids += i.tolist()
        n += k.tolist()
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n == [len(w) for w in want] and ids == [i for w in want for i in w]


def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(C.tokenizer_path("byte_bpe_50k.json"))
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store(spark, tmp_path):
    rows = [(i * 3 - 40, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    docs = documents(spark, tmp_path, rows, extra=("shard", "start", "offset"))
    store = S.write_store(spark, docs, C.tokenizer_path("byte_bpe_50k.json"), uri=f"file://{tmp_path}/store", shards=5)
    got = store.look_up(store.documents, digest=True).join(store.shards.select("shard", "start"), "shard")
    assert sorted([(r["doc_id"], r["start"] + r["offset"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()], key=str) == sorted(expected(rows), key=str)
    keys = spark.createDataFrame([(-40,), (2,), (10**6,), (3,)], "doc_id long")
    found = {r["doc_id"]: r["offset"] for r in store.look_up(store.route(keys)).collect() if r["offset"] >= 0}
    assert set(found) == {-40, 2}


def test_repeats_and_empty(spark, tmp_path):
    rows = [(1, "same")] * 9 + [(1, "other"), (2, "x")]
    store = S.write_store(spark, documents(spark, tmp_path, rows), C.tokenizer_path("byte_bpe_50k.json"), shards=2)
    got = store.read().collect()
    assert len(got) == 11 and all(r["offset"] >= 0 for r in got)
    none = S.write_store(spark, documents(spark, tmp_path, [], "none"), C.tokenizer_path("byte_bpe_50k.json"))
    assert none.read().count() == 0


def test_store_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = S.op3_token_store(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_very_long_text(spark, tmp_path, monkeypatch):
    """A text of 2 MB, read back in ranges smaller than it."""
    monkeypatch.setattr(S, "READ", 1000)
    rows = [(1, "some words and more " * 100_000), (2, "x"), (3, None), (3, "")]
    docs = documents(spark, tmp_path, rows, extra=("occurrence", "ids"))
    store = S.write_store(spark, docs, C.tokenizer_path("byte_bpe_50k.json"), shards=1)
    got = store.look_up(store.documents, digest=True).join(store.shards.select("shard", "start"), "shard").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, n, c) for d, _, n, c in expected(rows))


def test_route_finds_all(spark, tmp_path):
    rows = [(1, "same"), (1, "same"), (1, "other"), (2, "x"), (None, "no id"), (None, "none")]
    store = S.write_store(spark, documents(spark, tmp_path, rows), C.tokenizer_path("byte_bpe_50k.json"), shards=2)
    keys = spark.createDataFrame([(1,), (None,), (1,), (7,)], "doc_id long")
    got = store.look_up(store.route(keys)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "None", "None"] and all(r["offset"] >= 0 for r in got)
