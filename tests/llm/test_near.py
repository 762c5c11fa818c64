import numpy as np
import pytest
import xxhash

from mosaiq.llm import catalog, embedding_dedup, shared, simhash
from tests.oracle import SF


def union(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def plain_fingerprint(text, n=4, nth=0):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    if nth:
        top = (1 << 64) - 1
        mixed = []
        for h in hashes:
            x = (h + nth * 0x9E3779B97F4A7C15) & top
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
            x = (x ^ x >> 27) * 0x94D049BB133111EB & top
            mixed.append(x ^ x >> 31)
        hashes = mixed
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_position_sets_cover():
    from itertools import combinations

    for width, n in ((3, 20), (4, 70)):
        sets = simhash.position_sets(width)
        assert len(set(sets)) == n
        assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


@pytest.mark.parametrize("which", ["sf", "odd", "none"])
def test_op4_against_brute(spark, which, odd_docs, no_docs, as_table):
    d = SF if which == "sf" else as_table(odd_docs if which == "odd" else no_docs)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    tops = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for r, t in zip(docs, tops, strict=True):
        if r["doc_id"] is not None:
            least[t] = min(r["doc_id"], least.get(t, 1 << 62))
    want = sorted(((r["doc_id"], f"{f:016x}", least.get(t)) for r, f, t in zip(docs, fps, tops, strict=True)), key=repr)
    assert sorted((tuple(r) for r in catalog.queries()["op4_simhash"](spark, d).collect()), key=repr) == want


@pytest.mark.parametrize(("many", "long"), [(1, 4096), (10**9, 4096), (10**9, 7)])
def test_links_of_many_close_fingerprints(spark, many, long, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "LIST", long)
    monkeypatch.setattr(simhash, "SHORT", min(16, long))
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    while len(fps) < 900:
        x = int(rng.choice(sorted(fps)))
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.selectExpr("doc_id", "array(cast(text as long)) as fps"))
    docs = spark.createDataFrame([(i, str(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, text string")
    tops = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs).collect()) == list(enumerate(tops))


@pytest.mark.parametrize("hot", [3, 200])
def test_components_of_chains_and_stars(spark, hot, monkeypatch):
    monkeypatch.setattr(shared, "HOT", hot)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000, 5000), (7001, 7000)]
    got = {r["u"]: r["v"] for r in shared.components(spark.createDataFrame(links, "u long, v long").repartition(8)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 500)}, 7001: 7000}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    links = [(a, b) for k, a in enumerate(ok) for b in ok[:k] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    tops = union(len(rows), links)
    least = {}
    for (i, _), t in zip(rows, tops, strict=True):
        least[t] = min(least.get(t, i), i)
    degree = np.bincount(np.array(links, int).reshape(-1), minlength=len(rows)) if links else [0] * len(rows)
    return sorted((i, int(degree[k]), least[tops[k]], i == least[tops[k]]) for k, (i, _) in enumerate(rows))


def test_op10_against_brute(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, catalog.queries()["op10_embedding_dedup"](spark, SF).collect())) == brute_vectors(rows)


def test_op10_hot_and_odd(spark, monkeypatch, as_table):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.12).tolist()) for i in range(200)] + [(i, rng.standard_normal(16).tolist()) for i in range(200, 320)]
    rows += [(i, centre.tolist()) for i in range(320, 380)] + [(380, (centre * 3).tolist()), (381, None), (382, [0.0] * 16), (383, [float("nan")] * 16), (384, [None, 1.0]), (385, []), (386, [float("inf")] + [1.0] * 15), (387, centre[:5].tolist()), (388, [1e-200] * 16), (389, [2e-200] * 16)]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, raw string, node string").repartition(5)
    d = as_table(docs, "embeddings")
    got = sorted(map(tuple, catalog.queries()["op10_embedding_dedup"](spark, d).collect()))
    want = brute_vectors([(i, v if i not in (388, 389) else [1.0] * 16) for i, v in rows])
    assert got == want
    assert catalog.queries()["op10_embedding_dedup"](spark, as_table(docs.limit(0), "embeddings")).count() == 0
