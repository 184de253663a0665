"""Binds a star schema of customers, orders and order lines to genomes, genes and domain hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Genomes:
    """Readers of the bound tables under one folder."""

    spark: SparkSession
    sf_dir: str

    def genes(self) -> DataFrame:
        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        start = (F.col("o_orderkey") % 4) * 4000 + day
        return table(self.spark, self.sf_dir, "orders").select(
            F.col("o_custkey").alias("organism_id"),
            F.when(F.col("o_orderkey") % 5 == 0, "plasmid").otherwise("chr").alias("molecule_id"),
            F.col("o_orderkey").alias("gene_id"),
            start.alias("gene_start"),
            (start + 300 + (F.col("o_orderkey") * 37) % 900).alias("gene_end"),
            F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"),
        )

    def molecules(self) -> DataFrame:
        length = F.when(F.col("molecule_id") == "chr", 36000 + 100 * (F.col("organism_id") % 100)).otherwise(35000)
        return self.genes().select("organism_id", "molecule_id").distinct().withColumn("length", length.cast("long"))

    def hits(self) -> DataFrame:
        lines = table(self.spark, self.sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate", "l_quantity")
        parts = table(self.spark, self.sf_dir, "part").select("p_partkey", "p_size")
        order = Window.partitionBy("gene_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
        factor = F.when(F.col("domain_id") % 4 == F.col("gene_id") % 4, 1).otherwise(10)
        sized = lines.withColumnRenamed("l_orderkey", "gene_id").join(parts.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
        joined = sized.join(self.genes().select("organism_id", "gene_id"), "gene_id")  # last, so that the lines of a gene are in one place for the window
        return joined.withColumnRenamed("p_size", "domain_id").select(
            "organism_id", "gene_id", "domain_id", ((51 - F.col("l_quantity")) * factor / 40000.0).alias("evalue"), F.row_number().over(order).cast("long").alias("line_no")
        )

    def clans(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "part").where("p_size % 5 <> 0").select(F.col("p_size").alias("domain_id"), (F.col("p_size") % 20).alias("clan_id")).distinct()

    def go_domain(self) -> DataFrame:
        d = table(self.spark, self.sf_dir, "part").select(F.col("p_size").alias("domain_id")).distinct()
        return d.select((F.col("domain_id") % 12).alias("go_id"), "domain_id").union(d.select((F.col("domain_id") * 7 % 12).alias("go_id"), "domain_id")).distinct()

    def go_terms(self) -> DataFrame:
        g = self.go_domain().select("go_id").distinct()
        return g.select(
            "go_id", F.concat(F.lit("term "), "go_id").alias("name"),
            F.when(F.col("go_id") % 3 == 0, "molecular_function").otherwise("biological_process").alias("namespace"),
            F.when(F.col("go_id") % 4 == 1, '"OBSOLETE. t"').otherwise('"t"').alias("def"),
        )

    def lineages(self, leaves: DataFrame) -> DataFrame:
        """A row per leaf: region, nation and organism, with their branch lengths."""
        customers = table(self.spark, self.sf_dir, "customer").select(F.col("c_custkey").alias("organism_id"), F.col("c_nationkey").alias("nation"), ((F.col("c_acctbal") + 1000) / 1000).alias("leaf_dist"))
        nations = table(self.spark, self.sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
        return leaves.select("organism_id").distinct().join(customers, "organism_id").join(nations, "nation").select(
            "organism_id", "nation", "region", "leaf_dist", (5 + 0.1 * F.col("nation")).alias("nation_dist"), (10.0 + F.col("region")).alias("region_dist")
        )
