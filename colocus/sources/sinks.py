"""Writers of results, and work that is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import probability_code
from .commits import Batches
from .text import labelled_newick


def todo(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Keys of wanted that are not done yet; all of them with force."""
    return wanted if force else wanted.join(done.select(*keys), keys, "left_anti")


def write_conserved(table: DataFrame, path: str, mode: str = "append") -> None:
    """The final table by subclade, with probabilities also as codes; pairs without occurrences are left out."""
    rows = table.where("occurrences <> 0").withColumn("prob_code", probability_code(F.col("prob")))
    rows.write.mode(mode).partitionBy("subclade_id").parquet(path)


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether the stored table at path has no row."""
    return spark.read.parquet(path).isEmpty()


def write_genomes(genes: DataFrame, folder: str, as_json: bool = False) -> None:
    """Coordinates, gene locations and molecule sizes of coding_genes; with as_json also as JSON lines, packed."""
    sizes = genes.groupBy("organism_id", "molecule_id").agg(F.max("length").alias("length"))
    parts = {"genes": genes.select("organism_id", "molecule_id", "gene_id", "gene_start", "gene_end", "strand"), "locations": genes.select("organism_id", "gene_id", "molecule_id"), "molecules": sizes}
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        if as_json:
            rows.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{name}_json")


def write_pair_index(index: DataFrame, path: str) -> None:
    index.select("pair_id", "domain1", "domain2").write.mode("overwrite").parquet(path)


def index_of(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The part of the pair index that pairs need."""
    return index.join(pairs.select("domain1", "domain2"), ["domain1", "domain2"], "left_semi")


def write_probabilities(organisms: DataFrame, pairs: DataFrame, uniform: DataFrame, folder: str, **more: DataFrame) -> None:
    """Pair likelihoods, uniform log probabilities and further tables of the organisms (organism_id, signature), as one batch.

    A run that ends before the batch is marked leaves nothing that is read; see commits.Batches.
    """
    Batches(organisms.sparkSession, folder).write(organisms, pairs=pairs, uniform=uniform, **more)


def write_composition(closure: DataFrame, path: str, mode: str = "append") -> None:
    """Which organisms each subclade holds."""
    closure.select("subclade_id", "organism_id").write.mode(mode).parquet(path)


def subclades_done(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("subclade_id").distinct()


def write_labelled_newick(tree: DataFrame, path: str) -> None:
    """One text file with the tree's numbers and names."""
    text = labelled_newick(tree)
    tree.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_distances(go: DataFrame, non_go: DataFrame, folder: str, mode: str = "append") -> None:
    """Distances of gene pairs that share a term and of those that do not."""
    for name, rows in (("go", go), ("non_go", non_go)):
        rows.select("organism_id", "gene1", "gene2", "distance").write.mode(mode).parquet(f"{folder}/{name}")


def write_matrix(distances: DataFrame, path: str, value: str = "distance", organisms: list[str] | None = None) -> None:
    """Pairs of leaves as a long table; given the organisms, as a square CSV table with 0 on the diagonal."""
    if organisms is None:
        distances.write.mode("overwrite").parquet(path)
        return
    both = distances.select("organism1", "organism2", value).union(distances.select("organism2", "organism1", value))
    wide = both.groupBy("organism1").pivot("organism2", organisms).agg(F.first(value))
    wide.select("organism1", *[F.coalesce(F.col(f"`{o}`"), F.lit(0.0)).alias(o) for o in organisms]).orderBy("organism1").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_statistics(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of permutations or bootstraps, added to those at path; nulls are NA."""
    rows.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_ontology(terms: DataFrame, go_domain: DataFrame, folder: str) -> None:
    """The terms, the filtered mapping, and the lists of either side of it."""
    write_tsv(terms, f"{folder}/terms")
    write_tsv(go_domain.select("go_id", "domain_id"), f"{folder}/mapping")
    for name, key, value in (("go_domains", "go_id", "domain_id"), ("domain_terms", "domain_id", "go_id")):
        go_domain.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("members")).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_weights(closure: DataFrame, path: str) -> None:
    """organism, weight and subclade, the root by its name."""
    subclade = F.when(F.col("subclade_id") == 0, "root").otherwise(F.col("subclade_id").cast("string"))
    closure.select("organism_id", "weight", subclade.alias("subclade_id")).write.mode("overwrite").option("sep", "\t").csv(path)


def write_parameters(params: DataFrame, mean: DataFrame, folder: str) -> None:
    """Each genome's parameters with a header, and the mean ones in two lines."""
    table = params.select(F.col("organism_id").alias("Assembly"), F.col("half").alias("Half_genome_size"), F.col("rate").alias("Lambda"), F.col("phi").alias("Phi"))
    write_tsv(table, f"{folder}/organisms")
    rows = mean.select(F.explode(F.array(*[F.concat_ws("\t", F.lit(f"Estimated_{n}"), F.col(c).cast("string")) for n, c in (("lambda", "rate"), ("phi", "phi"))])).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(f"{folder}/mean")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
