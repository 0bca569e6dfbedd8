"""A Python data source that writes a file per document, under a name of its own.

Spark's text writers open a Hadoop stream for each file, which was measured at some
30 ms of a core on a local disk. Here each task writes its files through ``pyarrow.fs``,
so any store that it knows will do.

A file appears whole: it is written under a hidden name, then moved to its own in the
same folder, over one that is there. So a task that is run again leaves the same files,
and readers skip what a lost one has left. A job that fails leaves the files that it
has written. Of rows that share a name one stays.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Arrow batches of texts are at most about so many bytes.
BATCH_BYTES = 2 << 20


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        made, own = set(), uuid.uuid4().hex
        for batch in iterator:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value")):
                folder, base = posixpath.split(f"{root}/{name}")
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                hidden = f"{folder}/.{own}"
                with store.open_output_stream(hidden, compression=None, buffer_size=None) as out:
                    out.write(value.as_buffer())
                store.move(hidden, f"{folder}/{base}")
        return WriterCommitMessage()


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_documents(df: DataFrame, path: str, name: str = "name", value: str = "value") -> None:
    """Writes each text into the file of its name (folders and all) below ``path``; rows without a name or a text make no file.

    Sets the session's bound on the bytes of Arrow batches to at most 2 MB: a worker holds a batch, however long the texts are.
    """
    spark = df.sparkSession
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.dataSource.register(DocumentSource)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    rows.filter("name is not null and value is not null").write.format("documents").mode("append").save(path)
