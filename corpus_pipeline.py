"""A training-corpus pipeline: five of the operators of roadweave.llm in a row, each on all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with
the columns of documents. run(spark, sf_dir) applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import bpe, decontam, langid, secrets, simhash
from roadweave.llm._common import checkpointed, held_out, table

#: A document of which less than this share of n-grams belongs to any language is rejected, as is one without a letter.
LEAST_SCORE = 0.1


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with columns c0, c1, ..., so that none clashes with an operator's, and the text's name among them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; null texts, texts without a letter and those in none of them go."""
    model = langid.train(docs.where(~held_out()))
    plain, text = _plain(docs)
    known = langid.identify(plain, model, text)
    kept = known.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id; rows without id go, rows that repeat an id and text are one document."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    plain, text = _plain(docs)
    found = decontam.contamination(plain, table(spark, sf_dir, "benchmark"), text)
    return found.where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars counts the text as it is then."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (unsigned 32-bit little-endian), and digests of the ids and of what they decode to."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the trained stages nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
