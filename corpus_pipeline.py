"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Rows with a null
id or text pass every stage (there is nothing to reject, group or replace); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabella.llm import mixing, neardup, packing, pseudonyms, toxicity
from tabella.llm.common import saved, spare
from tabella.session import load

#: Stands for the secret of a real run.
PSEUDONYM_KEY = "pipeline, replace by a secret"
MIX_BLOCK = 100
#: Target weights by source; None takes the square root of each source's rows.
MIX_WEIGHTS: dict[str, float] | None = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go; the model learns from all labelled rows of this input."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8 or more): the smallest id."""
    return neardup.drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes format-preserving pseudonyms; ``n_chars`` follows the text."""
    out = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are interleaved to target weights (the square root of their size); the files hold the documents in that order.

    Every document is kept once: the weights say when a source's documents come, not whether. The packer reads the order.
    """
    return mixing.in_mixed_order(docs, MIX_WEIGHTS, block=MIX_BLOCK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bin, offset and sequence length; documents that come early in the mixture are in early bins."""
    place = spare(docs, "_place")
    return packing.pack(mixing.with_reading_order(docs, place), order=place).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("pii_pseudonyms", pii),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None  # fitted scores, keyed permutations and best-fit bins have no SQL form; tests/llm checks run() by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
