"""Reading: base tables, the landing zone and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.schemas import REGISTRY, TABLES

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table with its declared types, or any other Parquet table as it is."""
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def read_landing(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines below ``folder``, one ``source=<key>`` subfolder per source.

    Records that cannot be read keep their text in ``_corrupt_record``, so one bad source neither
    stops the others nor loses its own good records. A file that breaks off gives the lines before
    that; ``file_report`` tells of it. The lines are parsed as a column: the JSON reader refuses
    queries that only look at the bad records.
    """
    record = F.from_json(
        "value", f"{schema}, {CORRUPT} STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return _lines(spark, folder).select("source", record.alias("r")).select("source", "r.*")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", "true").text(folder)


def file_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder`` that is not empty, with the lines read from it and its ``state``.

    The bytes of the lines are compared with what the file says it holds: its length, or for gzip
    the size in its last four bytes. ``unreadable`` gave nothing, ``cut off`` less or other than it
    holds, ``read`` all. A line ends with one or two bytes, the last one perhaps with none. A gzip
    file made of several parts states the last one's size and counts as cut off.
    """
    name = F.element_at(F.split("path", "/"), -1)
    last = F.hex(F.substring("content", -4, 4))
    stated = F.conv(
        F.concat(*[F.substring(last, at, 2) for at in (7, 5, 3, 1)]), 16, 10
    ).cast("bigint")
    packed = F.lower(name).endswith(".gz")
    files = spark.read.format("binaryFile").load(folder).select(
        "source", name.alias("file"), F.col("length").alias("bytes"),
        F.when(packed, stated).otherwise(F.col("length")).alias("holds"),
        packed.alias("packed"),
    )
    lines = (
        _lines(spark, folder)
        .select("source", F.col("_metadata.file_name").alias("file"), F.octet_length("value").alias("size"))
        .groupBy("source", "file")
        .agg(F.count("*").alias("n_rows"), F.sum("size").alias("size"))
    )
    rows, size = F.coalesce("n_rows", F.lit(0)), F.coalesce("size", F.lit(0))
    least, most = size + rows - 1, size + 2 * rows
    # The size that gzip states is counted modulo 2 ** 32.
    over = F.when(F.col("packed"), F.pmod(F.col("holds") - least, F.lit(2**32))).otherwise(F.col("holds") - least)
    state = (
        F.when((rows == 0) & (F.col("bytes") > 0) & (F.col("holds") > 0), "unreadable")
        .when((rows > 0) & ~over.between(0, most - least), "cut off")
        .otherwise("read")
    )
    return files.join(lines, ["source", "file"], "left").select(
        "source", "file", "bytes", rows.cast("bigint").alias("n_rows"), state.alias("state")
    )


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files per source, and how many of them could not be read whole."""
    return file_report(spark, folder).groupBy("source").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("state") != "read").alias("n_broken")
    )


def good_records(landed: DataFrame) -> DataFrame:
    return landed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(landed: DataFrame) -> DataFrame:
    return landed.filter(F.col(CORRUPT).isNotNull()).select("source", CORRUPT)


def load_report(landed: DataFrame, corrupt: str = CORRUPT) -> DataFrame:
    """Records and unreadable records per source."""
    return landed.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(corrupt).isNotNull()).alias("n_bad"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The configured sources, a JSON list of key, name, description and url."""
    return spark.read.schema(REGISTRY).json(path, multiLine=True)


def registry_rows(spark: SparkSession, sources: dict[str, dict[str, str]]) -> DataFrame:
    """The configured sources from a mapping of key to name, description and url."""
    rows = [
        (key, entry["name"], entry.get("description"), entry["url"])
        for key, entry in sources.items()
    ]
    return spark.createDataFrame(rows, REGISTRY)


def source_urls(registry: DataFrame) -> DataFrame:
    return registry.select("key", "url")
