import hashlib

import numpy as np
import pytest

from mosaiq.llm import catalog, exact_dedup, mixing
from tests.oracle import SF, rows, same


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_mixing"])
def test_same_as_sql(spark, name):
    same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_mixing"])
def test_odd_rows(spark, name, odd_docs, no_docs, as_table):
    for docs in (odd_docs, no_docs):
        d = as_table(docs.drop("digest", "row", "size", "key", "shard", "h", "u", "v", "taken", "frame"))
        same(catalog.queries()[name](spark, d), catalog.oracle_sql()[name], d)
    clash = catalog.queries()[name](spark, as_table(odd_docs))
    assert clash.count() == odd_docs.count()


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_mph_is_minimal_and_rejects_others(n):
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    keys = np.frombuffer(b"".join(map(digest, range(n))), np.uint8).reshape(-1, 32)
    pilots, slots = exact_dedup.build_mph(keys)
    assert sorted(slots) == list(range(n))
    back = np.argsort(slots)
    index = {"n": n, "pilots": pilots, "digests": keys[back]}
    member, slot = exact_dedup.lookup_mph(index, keys)
    assert member.all() and (slot == slots).all()
    others = np.frombuffer(b"".join(map(digest, range(n, 2 * n))), np.uint8).reshape(-1, 32)
    assert not exact_dedup.lookup_mph(index, others)[0].any()
    with pytest.raises(ValueError):
        exact_dedup.build_mph(np.concatenate((keys, keys[:1])))


TWO = "doc_id long, text string"


def test_history_and_nonmembers(spark):
    docs = spark.createDataFrame([(1, "old"), (2, "new"), (3, "new"), (4, "solo")], TWO)
    old = exact_dedup.group_digests(exact_dedup.text_digests(spark.createDataFrame([(100, "old"), (90, "unseen")], TWO)))
    for history in (old, old.unionByName(old)):  # a digest that is there twice is merged
        got = {r["doc_id"]: (r["keep_id"], r["kept"], r["repeats_history"]) for r in exact_dedup.exact_dedup(docs, history=history).collect()}
        assert got == {1: (100, False, True), 2: (3, False, False), 3: (3, True, False), 4: (4, True, False)}


def test_any_id_and_both_branches(spark, as_table):
    big = (1 << 63) - 1
    texts = [(-5, "a"), (-7, "a"), (None, "a"), (None, "b"), (None, "b"), (big, "c"), (-big, "c"), (big - 1, "d"), (big - 2, "d"), (-big + 1, "e"), (-big + 2, "e"), (0, "f"), (None, "f"), (-1, "g"), (0, "h")]
    d = as_table(spark.createDataFrame(texts, TWO))
    same(catalog.queries()["op5_exact_dedup"](spark, d), catalog.oracle_sql()["op5_exact_dedup"], d)
    d = as_table(spark.createDataFrame([(None, "x"), (None, "x"), (None, None)], TWO))
    same(catalog.queries()["op5_exact_dedup"](spark, d), catalog.oracle_sql()["op5_exact_dedup"], d)
    found = exact_dedup.exact_dedup(spark.createDataFrame([(i, f"t{i % 40}") for i in range(100)] + [(-100 + i, f"n{i % 7}") for i in range(30)], TWO)).collect()
    assert {r["repeats_history"] for r in found if not r["kept"]} == {True, False}


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 512)
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text")
    got = exact_dedup.exact_dedup(docs)
    assert got.where("kept").count() == 40_000 - 13_334 + 1
    assert got.where("group_size = 13334 and keep_id = 39999").count() == 13_334


def test_targets_are_capped_and_met(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 10 else f"s{i % 3}") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1e-6
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] and abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1
    assert rows(mixing.mix(docs.repartition(7))) == rows(mixing.mix(docs))
