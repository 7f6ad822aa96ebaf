"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longform.session import checkpoint_dir

# Word separators of the contracts: blank and 0x09-0x0D, which is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that begins with ``stem`` and that no frame has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` as its own, also beside columns of other frames and with dots in their names."""
    return [df[f"`{c}`"] for c in df.columns]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; no two calls share one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/longform-{kind}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that one Arrow batch hands to Python, so that long texts stay within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def bounded_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Bound the bytes that one Arrow batch hands to Python; a longer row is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, None)
    if have is None or not have.isdigit() or int(have) > limit:
        spark.conf.set(key, str(limit))
    small_batches(spark)


def crc_fold(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids: as the empty text)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes] | list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of whole texts of about ``limit`` bytes (of strings: characters); a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
