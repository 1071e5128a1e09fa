"""Session settings the operators count on, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Runtime settings only: they can be set on a session that already runs.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # A hot product, buyer or seller makes one shuffle partition of a join far larger than the
    # others; adaptive execution then splits that partition, even where it costs another shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The only rows that travel to Python are web pages; the default of 10,000 is too many of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder, as Parquet, and continue from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own machine. ``DataFrame.checkpoint`` would run the last stage
    twice and write whole rows, uncompressed.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/shelfwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


# Rows that a side of a join may have to be broadcast: about 12 MB of keys, prices and names.
FEW_ROWS = 50_000


def join_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, as a side of a join: broadcast if these are few, else merged.

    Spark takes the bytes of Parquet files for the size of what was read from them. Rows of a few
    values take a hundred times as many in a hash table, and the driver would build that.
    """
    return F.broadcast(df) if rows <= FEW_ROWS else df.hint("merge")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt out by ``key`` to all shuffle partitions.

    Without a number adaptive execution merges these by their bytes: a row of keys takes few in a
    shuffle and more than ten times as many in a hash table, which would grow to gigabytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``number``, the place of each row in the order, from 0 without a gap.

    The rows are range-partitioned and sorted by many tasks and written once; a row's number is its
    place in its partition and the sizes of those before, a row per partition.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33).alias("_part")  # the upper bits of the number
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    starts = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("number", F.col("_before") + inside)
        .drop("_part", "_at", "_before")
    )
