"""The corpus pipeline: documents in, encoded training rows out.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and calls one operator of
spotloom.llm with that operator's own parameters unless stated here.  Stages keep columns they don't know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import byte_bpe, decontaminate, fm_quality, secret_scan, similar
from spotloom.llm.common import Scratch, fresh, table

#: near duplicates inside the pipeline are judged on shingles of five words
PIPELINE_SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labels of documents (every labelled row may be learnt from here); rejected documents go."""
    machine = fm_quality.train(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True))
    score = fm_quality.scorer(spark, machine)
    return docs.where(score(F.col("text").cast("binary"), F.col("n_chars").cast("double")) >= fm_quality.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike (shingle sets of similarity LEAST or more, and chains of such) the row of the smallest id stays.  Rows without an id stay.

    SimHash by anchors finds the first of them, each checked by whole sets; the rest, which fingerprints miss, is found by shingles.
    """
    return similar.one_of_each(docs, n=PIPELINE_SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    own = fresh(docs, "marks")
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).where(F.size(f"{own}.ranges") == 0).drop(own)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, and n_chars follows."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests, and the token ids (little-endian unsigned 32-bit)."""
    return byte_bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("encoded", encoded),
]

#: hashing, automata and a fitted model: tests compare run() with a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
