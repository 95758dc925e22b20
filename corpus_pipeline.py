"""A corpus from raw documents to token ids, in five stages; each is written as Parquet and read again.

Every stage works on all rows the one before kept, and takes any columns besides those of
`documents`; null and empty texts pass through all of them (a null text is an empty one to the
classifier and the encoder). Of near copies, the row of smallest id stays. Texts that lose
words to the substring or benchmark stage have a new n_chars.

SQL can express none of the stages exactly (a fitted classifier, XXH64 fingerprints, tokenizer merges), so
ORACLE_SQL is None and the tests hold each stage against an independent version on the smallest tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm import bpe, decontam, quality, simhash, substring
from descmap.llm._util import shared_dir, small_batches, table
from descmap.operators.graph import remove_dir

ORACLE_SQL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is one half at least."""
    model = quality.fit(docs, quality.ratings(table(spark, sf_dir, "labels")), 3)
    return quality.score(docs, model, only_kept=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of those that links of 0.8 of their five-word shingles at least connect."""
    small_batches(spark)
    return simhash.one_of_each(docs, groups=simhash.alike)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that windows of 20 words from earlier places cover."""
    small_batches(spark)
    return substring.remove(docs, n_chars="n_chars")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows, and without documents that are mostly benchmark."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), n_chars="n_chars")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digest of the text decoded from them."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return decoded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table is removed when the next one's is written; the last one's stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    base, before = shared_dir(spark), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_dir(spark, before)
        before = f"{base}/{name}"
    return docs
