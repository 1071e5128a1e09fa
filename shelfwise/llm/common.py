"""What the operators of this package share: the shared folder, tables written to it, small columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import tune

_own_folder: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on: adaptive joins, small Arrow batches, UTC."""
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="shelfwise-llm-")
    return _own_folder[context.applicationId]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and continue from the files.

    This cuts the lineage and keeps results of costly steps where a lost executor cannot take them.
    """
    path = f"{shared_folder(df.sparkSession)}/shelfwise-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """The part a row belongs to: crc32 of its key as text, modulo ``parts``; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def chunks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``limit`` in all; a larger item is alone."""
    start = total = 0
    end = -1
    for end, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, end
            start, total = end, 0
        total += size
    if end >= start:
        yield start, end + 1
