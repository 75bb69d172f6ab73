"""From documents to packed training sequences: toxicity, language, near duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import language, minhash, packing, substrings, toxicity
from lexiloom.llm.common import drop_written, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. It learns from the labels of three of four documents.

    Null and empty texts have no hits and stay; repeated rows are each judged alike; texts are read whole; all columns are kept.
    """
    labels = table(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def in_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the column lang names go: without letters (null and empty texts too), or unlike every landmark.

    Repeated rows are each judged alike; texts are read whole; all columns are kept. Without a single named language all documents go.
    """
    return language.keep_identified(docs, language.fit_language(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id, with all columns.

    Null and empty texts are nobody's duplicates and stay; of repeated rows (same id and text) one stays; null ids stay.
    """
    return minhash.drop_near_duplicates(docs, words=5, percent=75)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that has them; what is left of a text keeps its white space.

    Null texts stay null, texts without such a passage stay as they are, repeated rows take nothing from each other; n_chars, if
    there is such a column, follows the text; all other columns are kept.
    """
    rest = docs.select("doc_id", "text", F.col("text").isNull().alias("_null"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    carried = [f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    out = substrings.remove_repeated(rest, window=50, carry=("_null", *carried), respace=False)
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(~F.col("_null"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(f"_{docs.columns.index('n_chars')}")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in sequences of 1024 tokens. Null and empty texts have an end id to pack; rows are packed as they come."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("language", in_known_languages),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeated_passages),
    ("packing", packed),
]
#: Learned models, similarity joins and a packing heuristic: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written to the shared folder and deleted once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
