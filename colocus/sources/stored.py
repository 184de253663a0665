"""Readers of stored results: JSON objects, parameters, weights, sizes, matrices and finished keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import label_code


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value (of the given type) of the JSON object in each file at path, plain or gzip."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def genome_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Molecules and lengths of a JSON object from organism to [molecule, length] pairs; at is a pair's place."""
    rows = json_object(spark, path, "array<array<string>>").select(F.col("key").alias("organism_id"), F.posexplode("value").alias("at", "pair"))
    return rows.select("organism_id", F.get("pair", F.lit(0)).alias("molecule_id"), F.get("pair", F.lit(1)).cast("long").alias("length"), "at")


def gene_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a JSON object from gene to [start, end] or [start, end, strand]."""
    at = [F.get("value", F.lit(k)) for k in range(3)]
    return json_object(spark, path, "array<bigint>").select(F.col("key").alias("gene_id"), at[0].alias("gene_start"), at[1].alias("gene_end"), at[2].cast("int").alias("strand"))


def organism_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Per-genome parameters from a table with a header: organism, half of the genome's size, lambda and phi."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.toDF("organism_id", "half", "rate", "phi").select("organism_id", *[F.col(c).cast("double").alias(c) for c in ("half", "rate", "phi")])


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """One row, rate and phi, from two lines of a name and a value."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).select(part[0].alias("name"), part[1].cast("double").alias("x"))
    return rows.agg(F.max(F.when(F.col("name").endswith("lambda"), F.col("x"))).alias("rate"), F.max(F.when(F.col("name").endswith("phi"), F.col("x"))).alias("phi"))


def root_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights of organisms in the root, from lines of organism, weight and subclade."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.element_at(part, -1) == "root")
    return rows.select(part[0].alias("organism_id"), F.element_at(part, -2).cast("double").alias("weight"))


def finished_bins(spark: SparkSession, path: str) -> DataFrame:
    """Subclades and bins whose statistics are stored at path."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("subclade_id").cast("long").alias("subclade_id"), F.col("bin").cast("long").alias("bin")).distinct()


def distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """organism1, organism2 and distance of a square table with labels in its header and first column.

    The labels are cut to their codes.
    """
    wide = spark.read.option("header", True).csv(path)
    first, *others = wide.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("double").alias("distance")) for c in others])).alias("cell")
    return wide.select(label_code(F.col(f"`{first}`")).alias("organism1"), cells).select("organism1", label_code(F.col("cell.label")).alias("organism2"), "cell.distance")


def genes_of(spark: SparkSession, path: str, organisms: list[str]) -> DataFrame:
    """Stored genes of some organisms; the predicate reaches the files."""
    return spark.read.parquet(path).where(F.col("organism_id").isin(organisms))
