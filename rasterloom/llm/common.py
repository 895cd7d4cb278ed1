"""What the operators share: text access, tables in the shared folder, size-checked semi and anti joins.

Conventions of every operator in this subpackage
------------------------------------------------
* ``docs`` needs ``doc_id`` and ``text``; some need ``lang`` and ``source``. Other columns are ignored, whatever their
  names; a missing optional column counts as null.
* Columns are taken by name once, into fresh frames, so extra columns can't clash with the internal ones.
* A null text counts as empty unless the operator says otherwise. Rows that repeat a doc_id are rows of their own.
* Intermediate tables are Parquet files below ``spark.checkpoint.dir``: an executor that is lost takes none with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, new_path, shared_dir, written  # noqa: F401

#: Rows up to which a column of ids is broadcast (a hash relation of some 32 bytes a row); beyond it, a shuffle join.
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch that a Python task handles at once.
SLICE_ROWS = 1_000

#: White space of the contracts' words, as a Java character class and as bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def column(df: DataFrame, name: str, kind: str):
    """The named column, or a null of that type where there is none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: Settings that bound what a task holds of a table of texts at once; a session that has its own keeps them.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
}


def bound_batches(spark: SparkSession) -> None:
    """For queries and stages: rows of whole texts are long, so Spark's default batches of them are replaced by smaller ones."""
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def sliced(batches, rows: int = SLICE_ROWS):
    """Arrow batches in parts of some rows, so that what is made of one is handed on before the next is read."""
    for b in batches:
        for a in range(0, max(1, b.num_rows), rows):
            yield b.slice(a, rows)


def take(df: DataFrame, *names: str) -> DataFrame:
    """doc_id, text and the named columns only."""
    kinds = {"doc_id": "bigint"}
    return df.select(*(column(df, n, kinds.get(n, "string")).alias(n) for n in ("doc_id", "text", *names)))


def joined_by_size(df: DataFrame, ids: DataFrame, on, how: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A semi, anti, inner or left join that broadcasts ids after counting them, and shuffles above the limit."""
    rows = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if rows <= limit else ids.hint("merge"), on, how)


def without(df: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of df whose doc_id isn't among ids."""
    return joined_by_size(df, ids.select("doc_id"), "doc_id", "left_anti", rows)
