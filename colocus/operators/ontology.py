"""Ontology terms, their domains, and gene pairs that share a term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import gene_pairs, salted


def biological_processes(terms: DataFrame) -> DataFrame:
    return terms.where((F.col("namespace") == "biological_process") & ~F.col("def").startswith('"OBSOLETE.'))


def process_domains(go_domain: DataFrame, terms: DataFrame) -> DataFrame:
    return go_domain.join(biological_processes(terms).select("go_id"), "go_id", "left_semi")


def mapping_lists(go_domain: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each key, in order."""
    return go_domain.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("members"))


def _entries(kept: DataFrame, go_domain: DataFrame) -> DataFrame:
    """Genes and domains of each term in each organism, for terms with more than one entry."""
    rows = kept.join(go_domain, "domain_id").select("organism_id", "go_id", "gene_id", "domain_id")
    return rows.withColumn("k_", F.count("*").over(Window.partitionBy("organism_id", "go_id"))).where("k_ > 1").drop("k_").distinct()


def go_gene_pairs(kept: DataFrame, go_domain: DataFrame) -> DataFrame:
    """Distinct unordered pairs of genes that share a term, genes with themselves too."""
    g = _entries(kept, go_domain).select("organism_id", "go_id", "gene_id").distinct()
    pairs = salted(g.withColumnRenamed("gene_id", "gene1"), g.withColumnRenamed("gene_id", "gene2"), ["organism_id", "go_id"]).where("gene1 <= gene2")
    return pairs.select("organism_id", "gene1", "gene2").distinct()


def go_pair_annotations(kept: DataFrame, go_domain: DataFrame) -> DataFrame:
    """Those pairs with all terms that they share and the domains that carry them."""
    e = _entries(kept, go_domain)
    a, b = e.toDF("organism_id", "go_id", "gene1", "d1"), e.toDF("organism_id", "go_id", "gene2", "d2")
    pairs = salted(a, b, ["organism_id", "go_id"]).where("gene1 <= gene2")
    found = pairs.groupBy("organism_id", "gene1", "gene2").agg(F.collect_set("go_id").alias("g"), F.collect_set("d1").alias("x"), F.collect_set("d2").alias("y"))
    return found.select("organism_id", "gene1", "gene2", F.sort_array("g").alias("go_ids"), F.sort_array(F.array_union("x", "y")).alias("domain_ids"))


def non_go_pairs(kept: DataFrame, go_domain: DataFrame) -> DataFrame:
    return gene_pairs(kept).join(go_gene_pairs(kept, go_domain), ["organism_id", "gene1", "gene2"], "left_anti")
