"""A corpus pipeline of four stages: language identification, quality rules, near-duplicate removal, packing.

Each stage takes the documents that its predecessor kept (doc_id, text, lang, source, n_chars) and works on all of them.
A null or repeated doc_id is allowed in all of them: rows are documents of their own. A null text is an empty one; it has no
language and goes at the first stage, which also replaces null languages. A null source is a group of its own. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, packing, quality
from tessera.llm.common import cut, without
from tessera.llm.queries import vocabulary_path
from tessera.plans.shipping import shipped

#: Least calibrated probability of the predicted language.
LEAST_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known with LEAST_SCORE at least, and states it as their lang. It is learned from the labelled ones."""
    docs = docs.select(COLUMNS)
    made = language.predict(docs, language.train(docs), keep=("text", "source", "n_chars"))
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return made.filter(known).withColumnRenamed("lang_pred", "lang").select(COLUMNS)


@shipped
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents within the fences of their language and source."""
    return quality.kept_rows(docs.select(COLUMNS))


@shipped
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, linked by shared shingles of five words at a Jaccard similarity of 0.8: that with the least id (null last), of several the first.

    Rows are told apart by their place in the table, so that repeated and null ids need no rule of their own. Texts without words are linked with nothing and stay.
    """
    docs = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))
    found = cut(jaccard.jaccard_classes(docs, id_col="_row", words=5, threshold=(80, 100)))
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    members = cut(found.join(groups, "component_id").select("_row", "component_id").join(docs.select("_row", "doc_id"), "_row"))
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "_row"))["_row"].alias("_row"))
    return without(docs, members.select("_row").join(stays.select("_row"), "_row", "left_anti"), "_row").select(COLUMNS)


@shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.tokenize_pieces(docs, vocabulary_path("byte_bpe_50k.json"))
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, docs.count())


STAGES = [("language", identify_language), ("quality", filter_quality), ("near_duplicates", remove_near_duplicates), ("packing", pack_sequences)]

#: A fitted classifier isn't expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
