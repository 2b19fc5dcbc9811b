"""The corpus pipeline: documents in, token ids and the text they decode to out.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept.  ``run`` applies the
stages to the whole documents table, each result written as a shared table and read again by the next
stage.

Cases, beside those of the operators: null and empty texts pass toxicity (they are scored by the bias),
are copies of each other in exact dedup, have no near copies, and are never taken by the mix, as they
have no words; rows with a null id pass the first three stages unless they are copies of another row
and may be mixed like others; rows that repeat an id and a text are one document from exact dedup on,
while a document that the mix takes several times is a row for each; very long texts are whole, but
for the one on a source's cut; columns beside doc_id, text and source keep their values whatever their
names, and all but doc_id end with the last stage; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from corvane.llm.common import documents
from corvane.llm.registry import vocabulary
from corvane.plans.scratch import materialize, release, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the one with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays."""
    return jaccard_join.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; ``n_chars`` follows a document that the budget cuts."""
    mixed = mixing.mix(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)"""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Models, recall and the vocabulary have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        if at == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        # what a stage wrote on its way goes once its result stands, and so does the table it read
        with scope() as kept:
            after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(after)
        release(docs)
        docs = after
