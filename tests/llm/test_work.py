import re
from pathlib import Path

import numpy as np
import pytest

from sparkloom.llm import work
from sparkloom.llm.op10_exact import exact_dedup

from .helpers import documents


def private_mb():
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(work._trim is None, reason="the C library can't trim")
def test_tidy_gives_memory_back():
    pins = []

    def run(batches):
        held = [np.ones(6000) for _ in range(4000)]  # 192 MB in pieces that aren't mapped apart
        pins.extend(held[::50])  # what lies between them stays
        del held
        yield from batches

    before = private_mb()
    assert list(work.tidy(run)(iter([1, 2]))) == [1, 2]
    assert private_mb() - before < 60


def test_local_tables_run_no_python_job(spark, tmp_path):
    rows = [(b"a", 2, {"doc_id": None, "back": -3}), (b"b", 1, {"doc_id": 4, "back": 0})]
    df = work.local_table(spark, rows, "digest binary, n long, best struct<doc_id: long, back: long>")
    assert sorted((bytes(r[0]), r[1], r[2].asDict()) for r in df.collect()) == rows
    assert work.local_table(spark, [], "a long, b struct<c: long>").count() == 0
    docs = documents(spark, tmp_path, [(k, "same" if k % 2 else f"text {k}") for k in range(20)])
    kept = exact_dedup(spark, docs)
    assert len(kept.collect()) == 11
    assert "ExistingRDD" not in kept._jdf.queryExecution().toString()
