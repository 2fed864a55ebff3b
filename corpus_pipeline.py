"""The corpus pipeline: stages that each call one operator of nodeloom.llm and take effect on the documents.

Each stage reads all that the one before kept. A null text is rejected by the first stage; an empty
table stays empty. Near duplicates are judged by row: rows of one id, or of none, are one only if their
texts are alike. Decontamination takes rows of one id as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import bpe, centroids, chosen_path, secrets, templates
from nodeloom.llm.common import Scratch, ship_code, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; ``lang`` becomes the predicted one, texts too far from every centroid go."""
    ship_code(spark)
    found = centroids.identified(docs, centroids.learn(docs), keep=tuple(docs.columns))
    return found.filter(~F.col("rejected")).select(*[F.col("lang_pred" if c == "lang" else c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    ship_code(spark)
    return chosen_path.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    ship_code(spark)
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced; ``n_chars`` follows."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts, and digests of the ids and of the bytes decoded from them."""
    ship_code(spark)
    return bpe.digests(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("secret_scan", mask_secrets), ("byte_bpe", encode)]
#: Several stages are models or run Python, so no SQL expresses the whole; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop(before)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
