import random

import numpy as np

import corpus_pipeline
from mosaiq.llm import overlap, shared, simhash
from tests.llm.test_near import union


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return words


def texts_near_the_bound(seed=3, bases=60):
    rng = random.Random(seed)
    out = []
    for b in range(bases):
        base = [f"b{b}w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 400))]
        out.append(" ".join(base))
        for share in (0.012, 0.018, 0.022, 0.026, 0.04):
            out.append(" ".join(edited(rng, base, max(1, round(share * len(base))))))
    return out


def kept_by_brute(rows):
    sets = [plain_shingles(t) for _, t in rows]
    tops = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    least = {}
    for (i, _), t in zip(rows, tops, strict=True):
        least[t] = min(i, least.get(t, i))
    return sorted(least.values())


def components_by_brute(rows):
    sets = [plain_shingles(t) for _, t in rows]
    tops = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    least = {}
    for (i, _), t in zip(rows, tops, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return [least.get(t) for t in tops]


def test_stage_links_from_0_8_on(spark):
    rows = list(enumerate(texts_near_the_bound()))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()) == kept_by_brute(rows)


def test_recall_at_the_bound():
    """Pairs that overlap by 0.80 to 0.82: the share that is a candidate of the index as planned for a large corpus."""
    least, prints, most = simhash.plan(200_000, 0.8)
    rng, caught, pairs = random.Random(7), 0, 0
    while pairs < 300:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 500))]
        other = edited(rng, base, max(1, round(0.0225 * len(base))))
        if not 0.8 <= jaccard(plain_shingles(" ".join(base)), plain_shingles(" ".join(other))) <= 0.82:
            continue
        a, b = (np.array(simhash.fingerprint(" ".join(x), 5, prints, True), np.uint64) for x in (base, other))
        differ = a ^ b
        bits = np.bitwise_count(differ).astype(int)
        caught += any(simhash.tally(differ[k : k + 1])[0] >= least and bits[k] + bits[(k + 1) % prints] <= most for k in range(prints))
        pairs += 1
    assert caught >= 0.95 * pairs


def test_blocks_and_long_lists_give_the_same_groups(spark, monkeypatch):
    rows = list(enumerate(texts_near_the_bound(5, 12)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(simhash.near_texts(docs).collect())
    assert [r["component_id"] for r in whole] == components_by_brute(rows)
    monkeypatch.setattr(overlap, "BLOCK", 300)
    assert sorted(simhash.near_texts(docs).collect()) == whole
    monkeypatch.setattr(shared, "HOT", 3)
    monkeypatch.setattr(simhash, "LIST", 3)
    monkeypatch.setattr(simhash, "SHORT", 2)
    assert sorted(simhash.near_texts(docs).collect()) == whole


def test_any_id(spark):
    far = (1 << 63) - 1
    rows = [(far, "a b c d e f g h"), (None, "a b c d e f g h"), (far - 1, "x y"), (None, "only here"), (-5, "z z z z z z z z z"), (None, "z z z z z z z z z"), (-1, "p q r s t u")]
    for some in (rows, rows[1:2] + rows[3:], [r for r in rows if r[0] is not None] + [(-far, "x y")]):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        found = [r["component_id"] for r in simhash.near_texts(docs).collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, components_by_brute(some)))
        assert simhash.near_groups(docs).where("component_id is null").count() == found.count(None)


def test_bound_itself_is_near():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)  # 8 of 10
    c = np.arange(2, 11, dtype=np.uint64)  # 7 of 11 with a, 8 of 10 with b
    assert overlap.similar_links([a, b]) == [(0, 1)]
    assert overlap.similar_links([a, c]) == []
    assert len(overlap.similar_links([a, c, b])) == 2
