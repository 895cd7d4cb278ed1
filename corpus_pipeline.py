"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing, SentencePiece ids.

Each stage takes all documents that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import common, jaccard, lines, mixing, quality, sentence_pieces

#: Production parameters.
MIN_DOCS, PERCENT, MODEL = 10, 80, "piece_bpe_32k.model"


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the text as it is now."""
    return out.select(*(F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep.

    Each row is judged by its own text, whatever its doc_id: null, or another row's. Null and empty texts go, equal rows go or
    stay together, and an empty table stays empty. Null languages and sources are groups of their own.
    """
    common.bound_batches(spark)
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that MIN_DOCS documents share; those that have no word left go, null and empty texts too.

    Each row counts as a document, also those that repeat a doc_id or have none. An empty table stays empty.
    """
    common.bound_batches(spark)
    out = lines.dedup_lines(docs, min_docs=MIN_DOCS, least=1)
    return _columns(out.where(F.col("text").rlike(common.WORD_CLASS)), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by doc_id.

    Of rows that repeat a doc_id, one stays: that of the least text digest. Rows without a doc_id have no links and stay, as do
    null and empty texts. An empty table stays empty.
    """
    common.bound_batches(spark)
    groups = common.written(jaccard.near_duplicates(docs, percent=PERCENT), "groups")
    ids = common.written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    left = common.without(docs, ids)
    again = common.written(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    n = again.count()
    if not n:
        return left
    row = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.xxhash64(*(f"`{c}`" for c in docs.columns)).alias("tie"), *(F.col(f"`{c}`") for c in docs.columns))
    one = common.joined_by_size(left, again, "doc_id", "left_semi", n).groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(row, F.struct(row["key"], row["tie"])).alias("row"))
    return common.without(left, again, n).unionByName(one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as rows that keep their doc_id; documents that it doesn't take go.

    Null and empty texts have size 0 and are taken like others of their source. Rows that repeat a doc_id, or have none,
    are taken alike. Null sources are one source. An empty table stays empty.
    """
    common.bound_batches(spark)
    return mixing.mixed_rows(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null or empty text has the begin and end ids only."""
    common.bound_batches(spark)
    return sentence_pieces.encode_decode(docs, public_tokenizers.path(MODEL), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", mix_sources),
    ("SentencePiece", piece_ids),
]

#: SQL expresses neither the covariance estimates nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{i}")
    return docs
