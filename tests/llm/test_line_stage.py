import hashlib

import corpus_pipeline


def made(name, n):
    return [f"{name} {i} {hashlib.md5(f'{name}{i}'.encode()).hexdigest()}" for i in range(n)]


def test_no_line_leaves_the_corpus(spark):
    shared, more = made("shared", 60), made("more", 40)
    texts = {
        1: shared,
        2: [*made("own", 3), *shared],  # a short own text
        3: [*made("first", 2), *shared, *more[:8]],  # holds the first place of chunks that are removed from 4
        4: [*more, *made("last", 30)],
        5: shared,  # an exact copy: nothing is left of it
        6: made("alone", 1),
        7: ["", " "],
    }
    docs = spark.createDataFrame([(i, "\n".join(x), "en", "a", 0) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert {line for t in got.values() for line in t.split("\n")} == {line for x in texts.values() for line in x}
    assert set(got) == {1, 2, 3, 4, 6, 7}
    assert len(got[2]) < 0.3 * len("\n".join(texts[2]))
