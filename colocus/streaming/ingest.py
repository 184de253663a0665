"""Incremental ingestion of domain-hit files with a file stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.text import domain_hits, organism_of


def ingest_hits(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Appends the hits of files not seen before to out, then stops; the checkpoint remembers the files."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", True).text(folder)
    rows = domain_hits(lines.select("value", organism_of(F.col("_metadata.file_name")).alias("organism_id")))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
