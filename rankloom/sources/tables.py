"""Reading and writing tables: files by split or extension, buckets, documents."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.scalars import bucket_of
from rankloom.sessions import GROUP

SPLITS = ("train", "test")


def scan(spark: SparkSession, root: str, dataset: str = "train", columns: list[str] | None = None) -> DataFrame:
    """``{root}/{dataset}.parquet``, lazily, a projection if given; a missing file raises."""
    df = spark.read.parquet(f"{root}/{dataset}.parquet")
    return df.select(*columns) if columns else df


def load_split(spark: SparkSession, root: str, split: str, columns: list[str] | None = None) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split is one of {', '.join(SPLITS)}, not {split}")
    return scan(spark, root, split, columns)


def partitioned(spark: SparkSession, root: str, split: str, columns: list[str] | None = None, view: str | None = None, persist: bool = False) -> DataFrame:
    """A directory of partitions, found by Spark; as a temporary view, and kept, on request."""
    df = spark.read.parquet(f"{root}/{split}")
    df = df.select(*columns) if columns else df
    df = df.persist() if persist else df
    if view:
        df.createOrReplaceTempView(view)
    return df


#: So many files are named to the reader one by one; beyond, rows meet the files' starts.
MOST_NAMED = 1000


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of a file, or of a folder's files by name, each in file order.

    Row counts come from the files' footers; files that start at row n or later are not read.
    """
    df = spark.read.parquet(path)
    sizes = df.groupBy(F.col("_metadata.file_path").alias("__path")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__path")) - F.col("__n")).filter(F.col("__start") < n)  # a row for each file
    named = starts.limit(MOST_NAMED + 1).collect()
    if len(named) <= MOST_NAMED:
        if not named:
            return df.limit(0)
        df = spark.read.schema(df.schema).parquet(*(r["__path"] for r in named))
        starts = spark.createDataFrame(named, starts.schema)
    placed = df.select("*", F.col("_metadata.file_path").alias("__of"), F.col("_metadata.row_index").alias("__row")).join(F.broadcast(starts), F.col("__of") == F.col("__path"))
    return placed.filter(F.col("__start") + F.col("__row") < n).select(df.columns)


def schema_info(spark: SparkSession, path: str) -> DataFrame:
    """(position, column, type), from the file's footer."""
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(spark.read.parquet(path).schema)]
    return spark.createDataFrame(rows, "position int, column string, type string")


def read_by_extension(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    kind = os.path.splitext(path)[1]
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def write_by_extension(df: DataFrame, path: str) -> None:
    kind = os.path.splitext(path)[1]
    if kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == ".csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")


def json_documents(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """One row per ``*.json`` file below root: ``file`` (its name), ``value`` (its text)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    df = df.select(F.col("_metadata.file_name").alias("file"), "value")
    return df if most_files is None else df.limit(most_files)


def file_stem(column: str = "file") -> Column:
    """The file's name without folders and extension: the document's key."""
    return F.regexp_extract(column, r"([^/]+?)(?:\.[^./]*)?$", 1)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 64_000 * 16) -> None:
    """Snappy files of bounded row counts."""
    df.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file).parquet(path)


def append_parquet(df: DataFrame, path: str, rows_per_group: int = 64_000) -> None:
    """Adds files whose row groups hold at most so many rows each: a reader's, and the writer's buffer."""
    df.write.mode("append").option("compression", "snappy").option("parquet.block.row.count.limit", rows_per_group).parquet(path)


#: A task that packs documents reads about so many bytes of them.
TASK_BYTES = 128 << 20


def pack_documents(spark: SparkSession, root: str, path: str, file_bytes: int = 128 << 20) -> DataFrame:
    """The ``*.json`` files below root as a table (file, value) of files of about so many bytes: many small files are listed and opened once.

    Files are read as binary ones, whose lengths need no opening; a text of many small files takes four times as long to read.
    Spark gives a task no more than some 32 files, however small; such tasks are put together, so that they grow with the bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    tasks = 8 * spark.sparkContext.defaultParallelism
    total = files.select("length").coalesce(tasks).agg(F.sum("length")).first()[0] or 0
    read = files.select(F.col("_metadata.file_name").alias("file"), "content").coalesce(max(tasks, total // TASK_BYTES))  # right below a repartition it would be dropped
    docs = read.select("file", F.col("content").cast("string").alias("value")).repartition(max(1, -(-total // file_bytes)), "file")
    docs.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema("file string, value string").parquet(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for submissions and reports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_hash_partitioned(df: DataFrame, path: str, key: str = GROUP, n: int = 100) -> None:
    """A directory per hash bucket of the key; one shuffle, one file per bucket."""
    name = f"{key}_mod_{n}"
    df.withColumn(name, bucket_of(F.col(key), n)).repartition(n, name).write.mode("overwrite").partitionBy(name).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str = GROUP, n: int = 100) -> None:
    """A bucketed, sorted table: joins and windows on the key need no shuffle."""
    df.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).saveAsTable(table)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
