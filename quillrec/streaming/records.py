"""Record files as a stream: each new file of a folder is cut into records and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrec.operators.decode import decode
from quillrec.plans.layout import Layout

_FILE = "path string, modificationTime timestamp, length long, content binary"


def split_records(files: DataFrame, layout: Layout) -> DataFrame:
    """path, record_index (within the file) and record from rows of ``path`` and ``content``; a cut-off record fails the query."""
    size = layout.record_length
    content = F.col("content")
    whole = F.when(F.octet_length(content) % size != 0, F.raise_error(F.concat(F.lit("incomplete record in "), F.col("path"))).cast("long"))
    count = F.coalesce(whole, (F.octet_length(content) / size).cast("long"))
    rows = files.withColumn("n", count).where("n > 0").select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("record_index"))
    return rows.select("path", "record_index", F.substring(content, (F.col("record_index") * size + 1).cast("int"), F.lit(size)).alias("record"))


def stream_decoded(spark: SparkSession, folder: str, layout: Layout, errors: str = "raise", max_files: int = 16) -> DataFrame:
    """A streaming DataFrame of path, record_index and the layout's columns. Files are read whole, so meant for files of some MiB."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", max_files).load(folder)
    return decode(split_records(files, layout), layout, errors=errors, keep=("path", "record_index"))
