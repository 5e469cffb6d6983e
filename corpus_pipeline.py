"""The training-text pipeline: each stage calls one operator; its Parquet result is the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.llm import minhash, mixing, packing, suffix, toxicity
from varlake.llm.queries import VOCABULARY
from varlake.llm.shared import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the pattern grammar scores as toxic; it learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs.select("doc_id", "text"), labels)
    return toxicity.scored(docs, model, score_col="__score").where(F.col("__score") < 0.5).drop("__score")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.one_of_each(docs, minhash.near_duplicates(docs, width=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 200 that start at more than one place. Documents of which nothing is left stay, empty."""
    cut = suffix.without_repeats(docs, length=200)
    if "n_chars" not in docs.columns:
        return cut
    chars = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return cut.withColumn("n_chars", chars)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix of the sources says: not, once or twice."""
    return mixing.mixed_rows(docs, mixing.mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row per piece with the sequence of 1024 tokens that it lies in."""
    return packing.packed_documents(docs, VOCABULARY, end_id=2, capacity=1024)[1]


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", one_per_group),
    ("suffix_array_dedup", cut_repeats),
    ("pivotal_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Trained scores, hashes and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
