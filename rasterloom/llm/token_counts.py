"""Operator 2: token counts behind a digest cache.

A document's digest (SHA-256 of its normalised content) and the tokenizer's (SHA-256 of its file) are the key of a
stored count. Digests that the cache lacks are encoded once each, however many documents share them, and their
counts are appended. Content is normalised by what can't change the count: null becomes the empty text.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
#: Chunks whose counts a Python worker remembers, twice over (see pieces.Memo).
MEMO = 150_000


def version(path: str) -> str:
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


@functools.cache
def counter(path: str):
    """texts -> token counts as the tokenizer's own library gives them, without special tokens. Loaded once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        apart = pieces.separable([sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])
        # A chunk of no more than its own leading space is one token; a line feed ends the space before it.
        memo = pieces.Memo(lambda x: len(sp.encode(x)) - (x[0] == "\n") if x else 1, MEMO)

        def count(texts):
            return [sum(map(memo.__getitem__, pieces.chunks(t))) if apart and pieces.SPACE not in t else len(sp.encode(t)) for t in texts]

        return count
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = False  # the library's default
        t.no_padding()
        t.no_truncation()
        return lambda texts: [len(e.ids) for e in t.encode_batch(list(texts), add_special_tokens=False)]
    raise ValueError(f"{path}: neither .model nor .json")


def with_digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """digest and n_tokens of every row of docs."""

    def run(batches):
        count = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count([x.as_py() or "" for x in b.column(1)]), pa.int64())], names=["digest", "n_tokens"])

    return docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text").mapInArrow(run, "digest binary, n_tokens bigint")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 4096, id_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; ``cache`` is the folder of the count table, made if absent.

    path: the tokenizer's file, at the same place on every executor. Null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows and equal texts share one encoding. An empty table gives no row.
    """
    spark = docs.sparkSession
    docs = common.take(docs)
    tokenizer = version(path)
    own = common.written(with_digests(docs), "digests")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    # One document stands for each digest that the cache lacks; partial minima run before the shuffle.
    misses = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored().select("digest"), "digest", "left_anti")
    misses = common.written(misses.select("doc_id"), "misses").where("doc_id is not null")
    n, total = misses.count(), own.count()
    if total:
        if n <= total - n:
            todo = common.joined_by_size(docs, misses.distinct(), "doc_id", "left_semi", n, id_rows)
        else:  # the documents that needn't be encoded are fewer
            todo = common.without(docs, own.join(misses.hint("merge"), "doc_id", "left_anti").select("doc_id").distinct(), None)
        # Rows without an id can't be looked up by it: those whose digest isn't stored are encoded too.
        rest = encoded(docs.where("doc_id is null"), path).join(stored().select("digest"), "digest", "left_anti")
        new = encoded(todo.where("doc_id is not null"), path).unionByName(rest).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        new.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # Appended twice by jobs that ran at once, a digest still counts once.
    # Written first, so that both sides of the join come straight from exchanges and Spark can split a hot digest.
    counts = common.written(stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    out = own.join(counts.hint("merge"), "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
