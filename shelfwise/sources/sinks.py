"""Writing: append, replace by key, upsert, schema union and orphan removal.

Nothing is changed in place. A changed table is a new snapshot folder, so a job that loses
executors, or is run twice, never damages its own input.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


COMMITS = "_commits"


def append_orders(orders: DataFrame, folder: str, key: tuple[str, ...] = ("id",)) -> bool:
    """Append order rows as one batch: readers see all of them or none.

    The rows go to a folder of their own, one subfolder per month, so that spend queries read few of
    them. A commit row names that folder once all its files are there; ``read_orders`` reads only
    committed folders, so a job that is lost between two months leaves nothing behind, and a batch
    can be repeated: rows whose ``key`` is held already are not written again. Rows without a full
    key are compared by what they have. Returns whether anything was written.

    Rows are rebalanced by month: few files for a small month, several tasks for a large one.
    """
    spark = orders.sparkSession
    dated = orders.withColumn("order_month", F.trunc("order_date", "month"))
    held = read_orders(spark, folder)
    if held is not None:
        dated = not_held(dated, held, *key)
    batch = f"batch={uuid.uuid4().hex}"
    dated.hint("rebalance", "order_month").write.partitionBy("order_month").parquet(f"{folder}/{batch}")
    written = spark.read.schema(dated.schema).parquet(f"{folder}/{batch}")
    if written.isEmpty():
        return False
    commit = spark.createDataFrame([(batch,)], "batch string")
    commit.coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")
    return True


def read_orders(spark: SparkSession, folder: str) -> DataFrame | None:
    """The orders of all committed batches with their ``order_month``; None if there is none yet."""
    try:
        commits = spark.read.schema("batch string").parquet(f"{folder}/{COMMITS}").collect()  # a row a batch
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not commits:
        return None
    paths = [f"{folder}/{row['batch']}" for row in commits]
    return spark.read.option("basePath", folder).option("mergeSchema", "true").parquet(*paths).drop("batch")


def not_held(dated: DataFrame, held: DataFrame, *key: str) -> DataFrame:
    """Rows whose key its month does not hold yet; null keys count as equal."""
    key = key or ("id",)
    own = held.select(
        F.col("order_month").cast("date").alias("_month"), *[F.col(c).alias(f"_{c}") for c in key]
    ).distinct()
    same = F.col("order_month").eqNullSafe(F.col("_month"))
    for column in key:
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return dated.join(own, same, "left_anti")


def write_snapshot(table: DataFrame, folder: str) -> None:
    """Write a table version to a folder that must not exist yet."""
    table.write.mode("errorifexists").parquet(folder)


def replace_by_key(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it does not hold."""
    kept = old.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new)


def with_audit(new: DataFrame, old: DataFrame, key: str, load_ts: datetime) -> DataFrame:
    """Creation and update time of the row being replaced; ``load_ts`` for a new row, and as the
    update time of one that differs."""
    data = [c for c in new.columns if c in old.columns and c not in (key, "created_at", "updated_at")]
    before = old.groupBy(key).agg(
        F.min(
            F.struct("created_at", "updated_at", F.struct(key, *data).alias("data"))
        ).alias("_before")
    )
    same = F.col("_before.data").eqNullSafe(F.struct(key, *data))
    return (
        new.drop("created_at", "updated_at")
        .join(before, key, "left")
        .withColumn("created_at", F.coalesce("_before.created_at", F.lit(load_ts)))
        .withColumn("updated_at", F.when(same, F.coalesce("_before.updated_at", F.lit(load_ts))).otherwise(F.lit(load_ts)))
        .drop("_before")
    )


def upsert_roasters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert sellers with a new url; for known ones take over the description only."""
    incoming = new.select(
        "url", *[F.col(c).alias(f"_{c}") for c in ("id", "name", "description")]
    )
    merged = old.join(incoming, "url", "full_outer")
    return merged.select(
        F.coalesce("id", "_id").alias("id"),
        F.when(F.col("id").isNotNull(), F.col("name")).otherwise(F.col("_name")).alias("name"),
        F.coalesce("_description", "description").alias("description"),
        "url",
    )


def union_schemas(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is null there."""
    return left.unionByName(right, allowMissingColumns=True)


def without_children_of(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of a child table whose parent was not deleted."""
    return child.join(deleted.select(key).distinct(), key, "left_anti")
