"""Incremental ingest of session documents: each file once, whatever stops in between.

A file is one document, or (``lines``) one document a line: many small documents are
best kept so. Names that end in ``.gz`` are unpacked as they are read, each in one task: such
files are best of some MB. The checkpoint remembers which files are done, by path; a second run reads only
new ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DOCUMENT = "value string"


def document_stream(spark: SparkSession, root: str, files_per_batch: int = 1000, pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """A stream of (file, value), one row per document."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(DOCUMENT).text(root, wholetext=not lines).select(F.col("_metadata.file_name").alias("file"), "value")


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000, pattern: str = "*.json", lines: bool = False) -> StreamingQuery:
    """Appends ``extract`` of the new documents to the Parquet folder ``out``, then stops."""
    rows = extract(document_stream(spark, root, files_per_batch, pattern, lines))
    query = rows.writeStream.format("parquet").option("compression", "zstd").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
