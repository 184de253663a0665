"""Results of organisms in batches, each of which counts from the moment its marker is written.

A batch is a folder of its own in every table, and its marker, one file written last, names the organisms
whose results it holds and the signatures of the inputs that they come from. What a run leaves behind that
ends before its marker is never read. Results of an organism whose inputs have changed since are not
current: it is work to do again, and its new results take the place of the old ones.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import organism_of


def signatures(spark: SparkSession, inputs: dict[str, str], needed: str, shared: tuple[str, ...] = (), settings: str = "") -> DataFrame:
    """organism_id and signature of every organism that has a file of the needed pattern.

    inputs gives the folder of each pattern of names. A signature covers names, sizes and times of change of
    an organism's files and of the shared ones, and the settings; contents are not read.
    """
    rows = reduce(DataFrame.unionByName, [_listed(spark, folder).where(F.col("name").contains(pattern)).withColumn("kind", F.lit(pattern)) for pattern, folder in inputs.items()])
    common = "|".join(sorted(f"{r['name']}:{r['stamp']}" for path in shared for r in _listed(spark, path).collect()))
    files = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "name", "stamp"))), "|")
    found = rows.groupBy(organism_of(F.col("name")).alias("organism_id")).agg(F.sha2(F.concat_ws("|", F.lit(settings), F.lit(common), files), 256).alias("signature"), F.bool_or(F.col("kind") == needed).alias("able"))
    return found.where("able").drop("able")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.concat_ws("@", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("stamp"))


class Batches:
    """The tables of one folder, written in batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self, wanted: DataFrame) -> DataFrame:
        """organism_id and batch of the wanted organisms' newest results, as far as their signatures are those wanted."""
        try:
            done = self.spark.read.parquet(f"{self.folder}/done")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing is committed yet
                raise
            return wanted.limit(0).select("organism_id", F.lit("").alias("batch"))
        newest = done.groupBy("organism_id").agg(F.max_by(F.struct("signature", "batch"), "at").alias("x"))
        return newest.select("organism_id", "x.*").join(wanted, ["organism_id", "signature"]).select("organism_id", "batch")

    def todo(self, wanted: DataFrame, force: bool = False) -> DataFrame:
        return wanted if force else wanted.join(self.current(wanted), "organism_id", "left_anti")

    def write(self, organisms: DataFrame, **tables: DataFrame) -> str:
        """Stores the tables' rows of the organisms (organism_id, signature), then the marker that makes them count."""
        batch = f"b-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/{name}/batch={batch}")
        self._mark(organisms, batch)
        return batch

    def _mark(self, organisms: DataFrame, batch: str) -> None:
        """One file, which is there as a whole or not at all."""
        try:
            at = self.spark.read.parquet(f"{self.folder}/done").agg(F.max("at")).first()[0] + 1
        except AnalysisException:
            at = 0
        rows = organisms.select("organism_id", "signature", F.lit(batch).alias("batch"), F.lit(at).cast("long").alias("at"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/done")

    def read(self, name: str, wanted: DataFrame) -> DataFrame:
        """The rows of a table that are current for the wanted organisms."""
        return self.spark.read.parquet(f"{self.folder}/{name}").join(self.current(wanted), ["organism_id", "batch"]).drop("batch")
