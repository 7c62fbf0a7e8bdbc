"""The corpus pipeline: stages over `documents`, each one of the operators of quaverlake.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
documents; the last returns each document's token ids and digests with its slot and place in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.bpe_automaton import digests, encode_decode
from quaverlake.llm.bradley_terry import accepted, fit
from quaverlake.llm.minhash import near_duplicates
from quaverlake.llm.pfair import interleave
from quaverlake.llm.shared import cut, table
from quaverlake.llm.surrogates import replace_entities


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is at least 0.5. Rows with a null id are scored like others."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates, and one of equal rows. A null id is in no group."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and counts the characters anew where something was replaced."""
    out = replace_entities(docs)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows in the order of the mixture; the written files follow it."""
    return interleave(docs).orderBy("slot", "place").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and digests. The mixture is the order of (slot, place), told anew from the
    rows, as files that are read again have no order and the columns of documents hold no place."""
    import public_tokenizers

    placed = interleave(docs).select("doc_id", "lang", "source", "text", "slot", "place")
    return digests(encode_decode(placed, public_tokenizers.path("word_bpe_49k.json")), "doc_id", "lang", "source", "slot", "place", "ids")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("PII surrogates", private),
    ("mixing sources", mix),
    ("BPE encoding", tokens),
]

#: Scores and signatures are not SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
