"""Likelihoods of clustering per organism and over many organisms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_exponential, log_uniform, posterior
from .pairs import PAIR

#: Default parameters of the mixture.
LAMBDA, PHI = 0.0004931, 0.07225


def organism_likelihoods(closest: DataFrame, counts: DataFrame | None = None, rate: float = LAMBDA) -> DataFrame:
    """Per organism and pair: summed log exponential density, occurrences, fusions, genes of each domain.

    Without counts, closest has the numbers of genes itself, and nothing is joined.
    """
    own = [] if counts is not None else [F.max(n).alias(n) for n in ("n_genes1", "n_genes2")]
    sums = closest.groupBy(*PAIR).agg(
        F.sum(log_exponential(F.col("distance"), rate)).alias("exp_prob"), F.count("*").alias("occurrences"), F.count_if("fused").alias("fusions"), *own
    )
    if counts is None:
        return sums
    one, two = counts.toDF("organism_id", "domain1", "n_genes1"), counts.toDF("organism_id", "domain2", "n_genes2")
    return sums.join(one, ["organism_id", "domain1"]).join(two, ["organism_id", "domain2"])


def uniform_log_probabilities(main: DataFrame) -> DataFrame:
    return main.select("organism_id", log_uniform(F.col("length") / 2.0).alias("log_uni_prob"))


def conserved(pairs: DataFrame, uniform: DataFrame, weights: DataFrame | None = None, by: tuple[str, ...] = (), phi: float = PHI, stable: bool = False) -> DataFrame:
    """Sums over organisms, weighted if weights(organism_id, *by, weight) are given, and the posterior."""
    rows = pairs.join(uniform, "organism_id")
    rows = rows.join(weights.select("organism_id", *by, "weight"), "organism_id") if weights is not None else rows.withColumn("weight", F.lit(1.0))
    w = F.col("weight")
    sums = rows.groupBy(*by, "domain1", "domain2").agg(
        F.sum(w * F.col("exp_prob")).alias("log_exp"), F.sum(w * F.col("occurrences") * F.col("log_uni_prob")).alias("log_uni"),
        F.sum("occurrences").alias("occurrences"), F.sum("fusions").alias("fusions"), F.sum("n_genes1").alias("n_genes1"), F.sum("n_genes2").alias("n_genes2"),
        F.count("*").alias("n_organisms"),  # an organism has one row a pair
    )
    return sums.where("occurrences > 0").withColumn("prob", posterior(F.col("log_exp"), F.col("log_uni"), phi, stable))
