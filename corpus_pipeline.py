"""From raw documents to packed sequences: language, quality, repeated lines, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from medweave.llm import language_id, line_dedup, near_dedup, packing, quality_rules
from medweave.llm.common import ship, small_batches, table, unused
from medweave.session import settle

TOKENIZER = "word_bpe_49k.json"
WORDS_KEPT = 150_000  # by an encoder, whose worker stands next to what the stages before left in the executor


def prepare(spark: SparkSession) -> None:
    """Code for the executors, and batches they have room for."""
    ship(spark)
    small_batches(spark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the others go."""
    prepare(spark)
    return language_id.keep_known(docs, language_id.learn(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least five of them hold but for the last one; n_chars as the text is then."""
    prepare(spark)
    (own,) = unused(docs, "_deduped")
    done = line_dedup.dedup_lines(docs, result=own)
    return done.withColumns({"text": F.col(own)["text"], "n_chars": F.char_length(F.col(own)["text"]).cast("long")}).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places."""
    from public_tokenizers import path

    prepare(spark)
    return packing.pack_documents(docs, path(TOKENIZER), keep_ids=False, words_kept=WORDS_KEPT).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # learned models and packing have no SQL; tests hold every stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
