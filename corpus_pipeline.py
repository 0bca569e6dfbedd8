"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one; all but the last return the columns of
``documents``. ``run`` applies them to the whole table.

In every stage null ids, and rows that repeat, are rows like others unless its
docstring says otherwise; texts are read whole, however long; other columns of the
input, whatever their names, are handed on (but by the last stage); an empty table
gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, language_id, mixing, ngram_join, personal_data
from rankloom.llm.common import shared_dir, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; the others go.

    Null and empty texts, and texts without a letter, are of no language and go, as does
    everything where no text has a language to learn from. Equal scores go to the first
    language by code point.
    """
    return language_id.accepted(docs, language_id.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Null ids come after all others; of equal ids the text of the least hash stays; of rows
    alike in id and text any one. Null texts are empty texts, and copies of one another.
    """
    return ngram_join.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, n_chars counted anew (null where the text is).

    Null and empty texts stay as they are; spans that overlap become one mask.
    """
    return personal_data.masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows that are taken twice stand twice.

    Documents without a word (null texts too) are taken 0 times and go; the null source is
    the last one; rows alike in id, source and text are taken so often together, any of them once more.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, n_tokens, digests of the ids and of what they decode to; a null text is the empty text."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("ngram_join", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("byte_bpe", token_ids),
]

#: No SQL: models, a random rounding and BPE are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
