import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from mosaiq.llm import byte_bpe, catalog, language_id, line_dedup
from tests.llm.test_near import union
from tests.llm.test_overlap import jaccard, plain_shingles
from tests.oracle import SF, same

TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def test_op3_same_as_sql(spark, odd_docs, no_docs, as_table):
    same(catalog.queries()["op3_line_dedup"](spark, SF), catalog.oracle_sql()["op3_line_dedup"])
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs, no_docs):
        d = as_table(docs.select(plain))
        same(catalog.queries()["op3_line_dedup"](spark, d), catalog.oracle_sql()["op3_line_dedup"], d)
    assert catalog.queries()["op3_line_dedup"](spark, as_table(odd_docs)).count() == odd_docs.count()


def test_chunks_resist_shifts(spark):
    lines = [f"line {i} {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new line", *lines[:150]])), (3, "only\nhere"), (4, "\n\n\n"), (5, "\n\n\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["kept_text"] == "\n".join(lines)
    assert 120 < got[2]["n_removed"] < 151 and got[2]["kept_text"].startswith("new line")
    assert got[3]["n_removed"] == got[4]["n_removed"] == got[5]["n_removed"] == 0


def test_nothing_is_left_of_an_exact_copy(spark):
    texts = ["\n".join(f"t{i} line {k}" for k in range(i)) for i in range(2, 40)]
    docs = spark.createDataFrame([(10 * n + c, t) for n, t in enumerate(texts) for c in (1, 2)], "doc_id long, text string")
    for r in line_dedup.line_dedup(docs).collect():
        assert r["kept_text"] == (texts[r["doc_id"] // 10] if r["doc_id"] % 10 == 1 else "")


def test_many_chunks_go(spark):
    text = "\n".join(f"line {i} {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(100_000))
    docs = spark.createDataFrame([(5, text), (6, text + "\nmore")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[5]["n_chunks"] > 15_000 and got[5]["kept_text"] == text
    assert 99_970 < got[6]["n_removed"] <= 100_000 and got[6]["kept_text"].endswith("\nmore")


def test_any_id(spark, as_table):
    texts = [((1 << 63) - 1, "a\nb"), (-(1 << 63), "a\nb"), (None, "a\nb"), (None, "c\nd"), ((1 << 63) - 1, "c\nd")]
    d = as_table(spark.createDataFrame(texts, "doc_id long, text string"))
    same(catalog.queries()["op3_line_dedup"](spark, d), catalog.oracle_sql()["op3_line_dedup"], d)


def brute_chunks(text):
    lines, out, run, before, marks = text.split("\n"), [], [], 0, []
    for line in lines:
        code = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        marks.append((before * 1_000_003 + code) % 2_147_483_647 % 3 == 0)
        before = code
    for i, line in enumerate(lines):
        run.append(line)
        if i == len(lines) - 1 or 0 < i < len(lines) - 2 and marks[i] and (i == 1 or not marks[i - 1]):
            out.append(run)
            run = []
    return out


def brute(rows, model):
    """The pipeline in plain Python, but for the fitted model itself."""
    rows = [r for r in rows if not model.predict(r["text"])[2]]
    first, cut = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for k, c in enumerate(brute_chunks(r["text"])):
            first.setdefault("\n".join(c), (r["doc_id"], k))
    for r in rows:
        kept = ["\n".join(c) for k, c in enumerate(brute_chunks(r["text"])) if len(c) < 2 or not re.search(r"\S", "\n".join(c)) or first["\n".join(c)] == (r["doc_id"], k)]
        text = "\n".join(kept)
        if text == r["text"] or re.search(r"\S", text):
            cut.append({**r, "text": text})
    sets = [plain_shingles(r["text"]) for r in cut]
    tops = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    least = defaultdict(lambda: 1 << 62)
    for r, t in zip(cut, tops, strict=True):
        least[t] = min(least[t], r["doc_id"])
    near = [r for r, t in zip(cut, tops, strict=True) if least[t] == r["doc_id"]]
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in near}
    per = Counter()
    for r in near:
        per[r["source"]] += sizes[r["doc_id"]]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(per))}
    capped = {}
    while True:
        free = [s for s in per if s not in capped]
        left = sum(per.values()) - sum(capped.values())
        over = {s: 3 * per[s] for s in free if left * weight[s] > 3 * per[s] * sum(weight[x] for x in free)}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, left * weight[s] / sum(weight[x] for x in free) if s in free else 0) for s in per}
    out = []
    for s in per:
        words = int(target[s] + 0.5)
        whole, rest = divmod(words, per[s]) if per[s] else (0, 0)
        for r in sorted((r for r in near if r["source"] == s), key=lambda r: hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()):
            n = sizes[r["doc_id"]]
            part = max(0, min(n, rest))
            rest -= n
            ids = TIK.encode_ordinary(r["text"])
            out += [(r["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * (int((whole * n + part) / n + 0.5) if n else 0)
    return sorted(out)


def test_pipeline_against_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit_documents(docs)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in got.select("doc_id", "ids_sha256").collect()) == brute([r.asDict() for r in docs.collect()], model)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes


CLASHES = ("rejected", "score", "lang_pred", "__text", "row", "length_before", "n_lines", "n_removed", "kept_text", "gone", "name", "nth", "nth_row", "times", "nth_time", "taken", "taken_id", "u", "node", "")


def test_stages_take_odd_rows(spark, odd_docs):
    """Nulls, ties, repeated rows and clashing names: what each stage must keep of them."""
    docs = odd_docs.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in odd_docs.columns))
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in CLASHES if c and c not in ("row", "u", "taken"))
        kept.append(Counter((r["doc_id"], r["text"]) for r in rows))
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert set(kept[0]) <= {k for k in texts if letters(k[1])} and kept[0][(1, "alpha beta gamma")] == 1 and kept[0][(None, "no id here")] == 1
    assert kept[1] == Counter({(i, t or ""): n for (i, t), n in texts.items()})  # nothing repeats by two lines
    assert kept[2] == Counter({(1, "alpha beta gamma"): 1, (3, None): 1, **{k: 1 for k in texts if k[0] in (6, 8, 10, 11, 12, None)}})
    assert (None, "no id here") in kept[3] and not any(t in (None, "", " \n\t ") for _, t in kept[3])
    encoded = corpus_pipeline.encode(spark, docs, "").collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in encoded) == sorted((repr(i), len(TIK.encode_ordinary(t or ""))) for (i, t), n in texts.items() for _ in range(n))


def test_stages_take_no_rows(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").collect() == []
