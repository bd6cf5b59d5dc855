"""From raw documents to token ids: language, near copies, benchmark leaks, secrets, tokens.

Every stage takes what the one before kept, written as Parquet and read again, and all but the
last return the columns of documents:

1. language: documents without a language (no letter), or of which no language has a clear share,
   go; a missing ``lang`` is filled in.
2. near_copies: documents whose fingerprints of four-word shingles differ in at most four bits are
   linked; of each group the document with the smallest id stays.
3. leaks: documents that hold a benchmark item go.
4. secrets: secrets are masked in the text, and ``n_chars`` follows.
5. tokens: (doc_id, n_tokens, ids_sha256, decoded_sha256) of byte-level BPE and back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm import bpe, decontaminate, language, secrets, simhash
from ticketscope.llm.common import ship, stored, table

# A text is taken for its language if at least this share of its letters is.
MIN_LANGUAGE_SCORE = 0.3

# Models and tokenizers have no form in SQL.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    names = ("_found_language", "_found_score")
    kept = language.with_language(docs, language.learned(docs), names).filter(
        (F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)
    )
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
