"""From raw documents to packed training windows: five stages, each one operator of cashtide.llm."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import jaccard, langid, mixing, packing, pii
from cashtide.llm.common import saved


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined (null text, or no letter in it) and sets `lang` to the predicted
    one. Ids are not looked at: null and repeated ones stay as they are. Extra columns pass through. An empty table stays
    empty."""
    return langid.relabelled(docs, langid.learned(docs.select("doc_id", "text", "lang")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (words in fives, Jaccard 0.8 or more): that of the smallest doc_id, nulls last.
    Extra columns pass through, whatever their names."""
    return jaccard.one_of_each(docs, Fraction(4, 5), 5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text, in place; no row goes. See pii.redact for null, empty and very long texts."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that sources come near their targets. Documents without words go; null
    sources are a source of their own; rows with null or repeated ids count as rows of their own. Extra columns pass through, whatever their names; texts of
    any length are kept whole."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens; a null or empty text is its end mark alone; a long one is cut into full windows. Extra columns are
    not read. See packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Trained models, a tokenizer and packing are in it: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
