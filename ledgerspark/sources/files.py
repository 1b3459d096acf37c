"""Card exports and governed seed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerspark.constants import REQUIRED_COLUMNS
from ledgerspark.operators.quality import missing_columns
from ledgerspark.schemas import MERCHANT_RULES
from ledgerspark.session import stored

HASH_COLUMNS = ["source_row_number", *REQUIRED_COLUMNS]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder; reads the header only, all columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def csv_scan(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Required columns of a CSV with header, as text, in a fixed order; extra columns are never parsed.

    The header is checked before any data is read, and the error names every missing column in order.
    """
    header = csv_header(spark, path)
    missing = missing_columns(header, required)
    if missing:
        raise ValueError(f"CSV is missing required columns: {missing}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    # Each file's header is compared with the schema, so files with another column order fail loudly.
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*[F.col(f"`{name}`") for name in required], "_metadata")


def latest_file(spark: SparkSession, folder: str) -> str:
    """Path of the most recently modified CSV of a drop folder, by listing only; file contents stay unread.

    A folder named like a CSV is one drop, as Spark writes it: all its part files, dated by the newest of them. It counts
    once it is complete.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .load([folder, *csv_folders(spark, folder)])
        .select("path", "modificationTime")
        .orderBy(F.desc("modificationTime"), F.asc("path"))
        .head(1)
    )
    if not files:
        raise FileNotFoundError(f"no CSV file in {folder}")
    parent = files[0]["path"].rsplit("/", 1)[0]
    return parent if parent in csv_folders(spark, folder) else files[0]["path"]


def file_system(spark: SparkSession, folder: str):
    """A folder's path and its file system. Readers cannot list folders or rename them, so this takes Hadoop's own interface."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def csv_folders(spark: SparkSession, folder: str) -> list[str]:
    """The folders in a drop folder that are named like a CSV, with their whole paths, without those that a job is still
    writing: until it is done, its part files lie below ``_temporary``, and some may be in place already."""
    path, system = file_system(spark, folder)
    found = system.listStatus(path) if system.exists(path) and system.getFileStatus(path).isDirectory() else []
    named = [one.getPath() for one in found if one.isDirectory() and one.getPath().getName().lower().endswith(".csv")]
    return [one.toString() for one in named if not system.exists(one.suffix("/_temporary"))]


def latest_file_scan(
    spark: SparkSession, folder: str, required: Sequence[str] = REQUIRED_COLUMNS
) -> DataFrame:
    return csv_scan(spark, latest_file(spark, folder), required)


def lineage_columns(scan: DataFrame, mode: str) -> DataFrame:
    """Add the 1-based row number, file name, mode and load time to a scanned export.

    Rows are numbered in file order; several files count on from one another in path order. The number comes
    from each input block's place in its file and the row's place in its block, so no row is sorted. The scan
    is written once in between, because both parts must come from one and the same read.
    """
    names = [name for name in scan.columns if name != "_metadata"]
    placed = scan.select(
        *names,
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__block"),
    )
    return number_blocks(placed).select(
        *names,
        "source_row_number",
        "source_file",
        F.lit(mode).alias("source_mode"),
        F.current_timestamp().cast("string").alias("ingested_at"),
    )


def number_blocks(placed: DataFrame) -> DataFrame:
    """Row numbers over (path, block start, place in block); one counted row per block is all that is ordered."""
    tagged = stored(placed.withColumn("__position", F.monotonically_increasing_id()), "load")
    blocks = tagged.groupBy("__path", "__block").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__position").alias("__start")
    )
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "__path", "__block", "__start", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    number = F.col("__offset") + F.col("__position") - F.col("__start") + 1
    return tagged.join(offsets, on=["__path", "__block"], how="left").withColumn("source_row_number", number)


def row_hash_key(df: DataFrame, columns: Sequence[str] = HASH_COLUMNS, name: str = "row_hash") -> DataFrame:
    """Stable row key: digest of the row number and all source columns, empty text for missing values.

    The row number keeps exact duplicate charges apart.
    """
    parts = [F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")) for column in columns]
    return df.withColumn(name, F.sha2(F.concat_ws("|", *parts), 256))


def seed_scan(spark: SparkSession, path: str) -> DataFrame:
    """Governed merchant rules. Patterns are literal text, compared in upper case."""
    rules = spark.read.schema(MERCHANT_RULES).option("header", True).option("enforceSchema", False).csv(path)
    return rules_frame(rules)


def rules_frame(rules: DataFrame) -> DataFrame:
    """Rules from any table with the seed columns, with the text they are compared by."""
    return rules.filter(F.col("pattern").isNotNull()).withColumn("match_text", F.upper("pattern"))

