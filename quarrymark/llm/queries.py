"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.llm import bpe, mixing, overlap, pii, subjects, topics
from quarrymark.llm.oracle import ORACLE
from quarrymark.sources.shared import staged
from quarrymark.sources.tables import table

__all__ = ["ORACLE", "QUERIES"]


def _shared(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "key_values").select("column_id", "key_value"), "column_id", "key_value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    half = _shared(spark, d).where(F.col("shared") * 2 >= F.least("size_a", "size_b"))
    return half.select(F.col("a").alias("column_id_a"), F.col("b").alias("column_id_b"))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).select(F.col("a").alias("column_id_a"), F.col("b").alias("column_id_b"), "shared", "size_a", "size_b", F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def p7_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text", counts_only=True)


FREE_TEXT = {"candidates": "resume_text", "posts": "body", "articles": "body"}


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """source_table, record_id, text, found, masked of every row of the tables with free text."""
    parts = [table(spark, d, t).select(F.lit(t).alias("source_table"), F.col("id").alias("record_id"), F.col(c).alias("text")) for t, c in FREE_TEXT.items()]
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    people = [(table(spark, d, t), "first_name", "last_name") for t in ("candidates", "employees")]
    # a delivery often repeats a text: each is marked once
    texts = staged(texts.distinct(), "texts")
    return pii.mentions(texts, "text", pii.gazetteer(texts, "text", people))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    each = _marked(spark, d).select("source_table", "record_id", F.explode("found").alias("m"))
    return each.select("source_table", "record_id", "m.kind", "m.mention").distinct()


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("source_table", "record_id", "masked").distinct()


#: Spellings of the languages of documents.
LANGUAGE_CODES = {"eng": "en", "deu": "de", "ger": "de", "spa": "es"}


TOKENIZER = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in tokens of byte_bpe_50k; languages by their normalised code; topics as a classifier of the hand labels' subjects says."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    code = F.lower("lang")
    for spelling, to in LANGUAGE_CODES.items():
        code = F.when(F.lower("lang") == spelling, to).otherwise(code)
    docs = docs.withColumn("lang", F.when(code.isin("en", "de", "es"), code))
    labels = table(spark, d, "subject_labels").select("doc_id", "subject").join(F.broadcast(table(spark, d, "subject_areas").select("subject").distinct()), "subject").distinct()  # a list of subjects
    names, weights = topics.token_weights(docs.select("doc_id", "lang", "text").join(labels, "doc_id").withColumnRenamed("doc_id", "key"), TOKENIZER)
    keyed = docs.select(F.struct("doc_id", "source", "lang").alias("key"), "text")
    sized = staged(topics.sized(keyed, "key", "text", names, weights, TOKENIZER), "tokens")
    sized = sized.select(F.col("key.doc_id").alias("key"), F.col("key.source").alias("source"), F.col("key.lang").alias("lang"), "topic", "tokens")
    return mixing.mixture(sized, table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).where("copies > 0").select(F.col("key").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.marginals(_mixture(spark, d), table(spark, d, "mix_targets"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return subjects.assigned(docs, "doc_id", "text", table(spark, d, "subject_labels").select("doc_id", "subject"), table(spark, d, "subject_areas"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject area, those without documents included."""
    areas = table(spark, d, "subject_areas").select("subject")
    return areas.join(_subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents")), "subject", "left").fillna(0)


QUERIES = {"p6_found": p6_found, "p6_masked": p6_masked, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_marginals": p8_marginals, "p9_found": p9_found, "p9_composition": p9_composition, "p7_ids": p7_ids, "p7_tokens": p7_tokens, "p3_found": p3_found, "p3_overlaps": p3_overlaps}
