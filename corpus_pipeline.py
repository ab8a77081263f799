"""Corpus preparation: language, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislecraft.llm import bpe, decontam, langid, ngram_join, pii
from aislecraft.llm.common import ship, small_batches, stored, table
from aislecraft.llm.queries import tokenizer_path

#: The share of a document's words that may stand in benchmark windows.
MOST_LEAKED = 0.0
#: A language's pooled probability below which a document counts as being in none.
LEAST_SCORE = 0.3


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that `docs` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that was learnt, go; without a language to learn all with letters stay.

    Null texts have no letters; repeated rows all stay or all go; whole texts count, however long; an empty table stays empty.
    """
    ship(spark)
    small_batches(spark)
    network = langid.fit(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = fresh("found", docs)
    label = langid.labelled(docs, network, found)
    return label.where((F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles join, the one of the smallest doc_id stays.

    Of rows that share that doc_id the one whose text sorts first stays; rows without doc_id all stay, and so do documents
    without words, which nothing links; an empty table stays empty.
    """
    ship(spark)
    small_batches(spark)
    return ngram_join.without_near_copies(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go; null texts and texts without words stay, repeated rows all stay or all go, an empty table or benchmark takes nothing away."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), MOST_LEAKED)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows. Every row stays, nulls as nulls."""
    ship(spark)
    small_batches(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to, a row for every row; a null text has no ids."""
    ship(spark)
    small_batches(spark)
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
