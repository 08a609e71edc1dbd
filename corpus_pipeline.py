"""From raw documents to token counts: five stages, each one operator of ``tallyweave.llm``.

Every stage works on all rows that the stage before it kept, and its decisions take effect:

1. language_id drops documents without a recognised language (no letter, or a score under
   ``langid.REJECT_BELOW``);
2. near_duplicates keeps the document of smallest doc_id of each group of linked texts (rows
   without a doc_id are judged by their texts like all others);
3. decontamination drops documents that the contamination rule condemns;
4. secrets replaces every secret in the text by a mark (n_chars follows);
5. bpe encodes what is left and returns the digests of its ids and of its decoded text.

Stages 1 to 4 return the columns of documents. Nulls, empty and long texts, ties, repeated
rows and empty tables are handled as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import bpe, decontam, jaccard, langid, secrets
from tallyweave.llm.util import dropped, held_out, release, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.select("doc_id", "text", "lang"), ~held_out(4, 2))
    return langid.identify(docs, model, least=langid.REJECT_BELOW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", redact_secrets), ("bpe", encode)]

#: SQL cannot express the classifier and the tokenizer; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what a stage has kept goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release()
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
