import hashlib
import zlib

import numpy as np

from sparkloom.llm import op05_media as M
from sparkloom.llm.work import table

from .helpers import documents


def slow(payload):
    """Frame by frame."""
    n = 1 + max(0, -(-(len(payload) - M.FRAME) // M.HOP))
    x = np.zeros((n - 1) * M.HOP + M.FRAME, np.float32)
    x[: len(payload)] = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    power = np.array([np.abs(np.fft.rfft((x[k * M.HOP : k * M.HOP + M.FRAME] - x[k * M.HOP : k * M.HOP + M.FRAME].mean()) * M._WINDOW)[1:]).astype(np.float64) ** 2 for k in range(n)]).reshape(n, M.BANDS, -1)
    best, top = power.argmax(2), power.max(2)
    peaks = [(t, b, best[t, b] + 32 * b) for t in range(n) for b in range(M.BANDS) if top[t, b] > 0 and (t == 0 or top[t, b] >= top[t - 1, b]) and (t == n - 1 or top[t, b] > top[t + 1, b])]
    out = []
    for i, (t, _, k) in enumerate(peaks):
        for u, _, m in peaks[i + 1 : i + 1 + M.FAN]:
            if u - t <= M.SPAN:
                out.append((t, (int(k) << 12) | (int(m) << 5) | (u - t)))
    return out


def test_fingerprint():
    r = np.random.default_rng(3)
    clips = [M.padded(r.integers(0, 255, n).astype(np.uint8).tobytes()) for n in (0, 1, 64, 200, 256, 257, 5000, 900)]
    got = M.fingerprints(clips)
    for c, (t, code) in zip(clips, got):
        # at each frame the codes may come in another order
        want = slow(c)
        assert abs(len(want) - len(t)) <= 2 and len(set(want) & set(zip(t.tolist(), code.tolist()))) >= 0.98 * len(want)
    assert all((a[1] == b[1]).all() for a, b in zip(got, [M.fingerprints([c])[0] for c in clips]))
    assert M.fingerprints([]) == []


def test_query(spark, tmp_path):
    rows = [(1, "hello"), (2, None), (3, ""), (None, "ünï"), (5, "x" * 64), (6, "y" * 200_000), (7, "hello"), (7, "hello"), (8, "".join(chr(33 + k * k % 89) for k in range(3000)))]
    docs = documents(spark, tmp_path, rows, extra=("wav", "feature"))
    got = {}
    for r in M.op5_media(spark, str(tmp_path)).collect():
        got.setdefault((r["doc_id"], r["n_bytes"]), []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[7, 5]) == 2
    for d, t in rows:
        raw = (t or "").encode()
        p = M.padded(raw)
        r = got[d, len(raw)][0]
        assert len(p) % 64 == 0 and len(p) >= 64
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] == len(M.to_wav(p)) and r["media_sha256"] == hashlib.sha256(M.to_wav(p)).hexdigest()
        pairs = M.fingerprints([p])[0]
        assert r["n_pairs"] == len(pairs[0]) and r["feature"] == M.sketch(pairs[1])
    assert got[1, 5][0]["feature"] == got[7, 5][0]["feature"] != got[8, 3000][0]["feature"] and len(got[8, 3000][0]["feature"]) == 8 * M.SKETCH
    stored = M.media(spark, docs, path=f"{tmp_path}/clips")
    one = stored.filter("doc_id = 1").first()
    assert M.from_wav(bytes(one["wav"])) == b"hello" + bytes(59) and len(one["times"]) == len(one["codes"])
    assert spark.read.parquet(f"{tmp_path}/clips").count() == len(rows)
    assert M.digests(M.store(spark, docs.limit(0))).count() == 0


def test_all(spark, sf_dir):
    """Every document against its text, with the fingerprint taken frame by frame."""
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = M.op5_media(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        p = M.padded(rows[r["doc_id"]].encode())
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(p), hashlib.sha256(p).hexdigest())
        if len(p) < 2000:
            assert r["n_pairs"] == len(slow(p))
