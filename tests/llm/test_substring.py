import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from mosaiq.llm import catalog, substring_dedup
from tests.oracle import SF


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 22, 31])
def test_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    if period in (7, 13, 21, 31):
        assert len(cover) * (len(cover) - 1) + 1 == period


@pytest.mark.parametrize("which", ["sf", "odd", "none"])
def test_op1_against_brute(spark, which, odd_docs, no_docs, as_table):
    d = SF if which == "sf" else as_table(odd_docs if which == "odd" else no_docs)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in catalog.queries()["op1_substring_dedup"](spark, d).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("wide", [4096, 2])
def test_planted_at_all_shifts(spark, monkeypatch, wide):
    monkeypatch.setattr(substring_dedup, "WIDE", wide)
    monkeypatch.setattr(substring_dedup, "BLOCK_ANCHORS", 50)
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 40)
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"x{rng.integers(1 << 40)}" for _ in range(n)]
    passage, rows = fresh(36), []
    for i in range(45):
        rows.append((i, " ".join(fresh(i) + passage[: 34 + i % 3] + fresh(int(rng.integers(30))))))
    rows.append((100, " ".join(["again"] * 90)))
    rows.append((101, " ".join((fresh(40) + ["mid"]) * 1 + fresh(3))))
    loop = fresh(36)
    rows.append((102, " ".join(loop + ["sep"] + loop)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs).collect()), key=repr)
    assert got == brute(rows)
    texts = {r["doc_id"]: r["kept_text"] for r in substring_dedup.substring_dedup(docs, with_text=True).collect()}
    assert texts[102] == "sep" and texts[100] == ""
