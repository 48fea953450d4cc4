"""A cleaning pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from serigraph.llm import mixing, ngram_join, packing, pii, quality
from serigraph.llm._common import shared_folder, table
from serigraph.llm.queries import TOKENIZER, id_remainder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, doesn't reject.

    Rows with a null or empty text have the score of one; rows that repeat are judged each; very long texts are read whole; all columns stay.
    """
    forest = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(id_remainder(3) != 1))
    return quality.accepted(docs, forest)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id; of equal rows one.

    Null and empty texts and null ids are like nothing else and stay; very long texts are compared whole; all columns stay.
    """
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; the column n_chars, if there is one, follows the text.

    Null texts stay null; rows that repeat are treated each; very long texts are searched whole; all other columns stay as they are.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, copies being equal rows.

    Null and empty texts have no size and are taken as often as their source; null is a source of its own; all columns stay.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; the columns are those of packing.pack().

    Null and empty texts are an end token; rows that repeat are packed each; only documents of more than a sequence are cut.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("personal data", without_personal_data),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and read again, and the one before it removed.

    Null and empty texts and repeated rows go through as the operators say; rows with a null doc_id stay, for they link with
    nothing. All columns but those that a stage sets stay, whatever their names, up to the last stage. An empty table gives
    an empty one. The result of the last stage stays in the shared folder, for whoever reads the returned rows.
    """
    docs = table(spark, sf_dir, "documents")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}"), True)
    return docs
