"""Main molecules, filtered hits, and one domain per clan and gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def main_molecules(molecules: DataFrame, order: str = "molecule_id") -> DataFrame:
    """Each organism's longest molecule; the first by `order` among equals."""
    best = F.min_by(F.struct("molecule_id", "length"), F.struct(-F.col("length"), F.col(order)))
    return molecules.groupBy("organism_id").agg(best.alias("m")).select("organism_id", "m.molecule_id", "m.length")


def filter_hits(hits: DataFrame, genes: DataFrame, molecules: DataFrame, evalue: float = 0.001) -> DataFrame:
    """Hits under the e-value on the organism's main molecule, with coordinates and the molecule's size."""
    good = hits.where(F.col("evalue") < evalue)
    main = main_molecules(molecules).withColumnRenamed("length", "size")
    placed = genes.select("organism_id", "gene_id", "molecule_id", "gene_start", "gene_end").join(main, ["organism_id", "molecule_id"])
    return good.join(placed, ["organism_id", "gene_id"]).select("organism_id", "gene_id", "domain_id", "evalue", "line_no", "gene_start", "gene_end", "size")


def unmatched_hits(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits of genes that have no coordinates."""
    return hits.join(genes.select("organism_id", "gene_id"), ["organism_id", "gene_id"], "left_anti")


def resolve_clans(hits: DataFrame, clans: DataFrame) -> DataFrame:
    """Of a gene's domains of one clan the one with the lowest e-value, the later line among equals; domains without clan stay."""
    known = hits.join(clans.select("domain_id", "clan_id"), "domain_id", "left")
    rank = F.row_number().over(Window.partitionBy("organism_id", "gene_id", "clan_id").orderBy("evalue", F.desc("line_no")))
    return known.withColumn("rank_", F.when(F.col("clan_id").isNotNull(), rank).otherwise(1)).where("rank_ = 1").drop("rank_")


def gene_domains(kept: DataFrame) -> DataFrame:
    """Distinct domains of each gene, with coordinates; dealt by organism, so that what is made within organisms needs no shuffle."""
    return kept.select("organism_id", "domain_id", "gene_id", "gene_start", "gene_end", "size").repartition("organism_id").distinct()


def domain_gene_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("organism_id", "domain_id").agg(F.count_distinct("gene_id").alias("n_genes"))


def gene_pool(kept: DataFrame) -> DataFrame:
    """Annotated genes numbered within their organism, with their share of its domains."""
    genes = kept.groupBy("organism_id", "gene_id", "gene_start", "gene_end", "size").agg(F.count("*").alias("n_domains"))
    whole = Window.partitionBy("organism_id")
    return genes.select(
        "organism_id", (F.row_number().over(whole.orderBy("gene_id")) - 1).cast("long").alias("gene_idx"), "gene_id", "gene_start", "gene_end", "size",
        (F.col("n_domains") / F.sum("n_domains").over(whole)).alias("weight"),
    )


def missing_inputs(molecules: DataFrame, hits: DataFrame) -> DataFrame:
    """Organisms with a genome but without hits."""
    return molecules.select("organism_id").distinct().join(hits.select("organism_id"), "organism_id", "left_anti")
