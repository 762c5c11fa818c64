"""A corpus pipeline of the operators in mosaiq.llm: documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm import byte_bpe, language_id, line_dedup, mixing, simhash
from mosaiq.llm.shared import discard, written

#: Words to a shingle of the near-duplicate stage, and the least overlap of two sets of them.
SHINGLE, SIMILAR = 5, (4, 5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects (no letters, or far from every language) go."""
    found = language_id.predict_documents(docs, language_id.fit_documents(docs), keep=True)
    return found.where("not rejected").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which they leave nothing but blanks; n_chars is counted anew."""
    found = line_dedup.line_dedup(docs, keep=True).where((F.col("n_removed") == 0) | F.col("kept_text").rlike("\\S"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of five-word shingles that overlap by 0.8 or more) the document of smallest id stays;
    rows of one id count as one, rows without id stay."""
    keep = simhash.near_texts(docs, SHINGLE, SIMILAR).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("row.text"), F.xxhash64("row"))
    named = rows.where("doc_id is not null").join(keep.hint("merge"), "doc_id", "left_semi").withColumn("nth", F.row_number().over(first))
    return named.where("nth = 1").select("row.*").unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one that a source takes in part counts from half its words on. Documents
    are told apart by id and text, so those without an id count too."""
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = mixing.mix(docs, with_name=True).groupBy("doc_id", "name").agg(F.max(times).alias("times")).where("times > 0")
    taken = taken.select(F.col("doc_id").alias("taken_id"), F.col("name").alias("taken_name"), "times")
    rows = docs.select("doc_id", mixing.text_name(F.col("text")).alias("name"), F.struct("*").alias("row"))
    both = rows.join(taken.hint("merge"), (F.col("name") == F.col("taken_name")) & F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return both.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True, keep=("lang", "source"))


STAGES = [
    ("language identification", identify_language),
    ("line deduplication", dedup_lines),
    ("near-deduplication", dedup_near),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; what a stage has read goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
