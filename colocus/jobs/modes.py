"""Jobs beside prediction: fit, permutations, bootstraps and sensitivity, from files to stored results.

Each goes on where an earlier run ended: organisms by batches with markers, bins by the keys in the stored
statistics. permute and resample_bins read what predict stored for a tree under the same folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fit as mixture
from ..operators import hits, ontology, resample, tree
from ..sources import commits, sinks, stored, text
from ..sources.scratch import staged
from .predict import annotated


def fit(
    spark: SparkSession, genomes: str, hit_folder: str, clans: str, ontology_path: str, mapping_path: str, out: str, newick: str | None = None, evalue: float = 0.001, non_go: bool = False, force: bool = False, **how
) -> DataFrame:
    """Every organism's own parameters, stored, and their mean, weighted by the tree where one is given; returns the mean.

    Stores the distances of gene pairs with a common term too, and with non_go the histogram of the other pairs'.
    An organism without such pairs, or whose every start ends as no mixture, has no parameters and is left out
    of the plain mean; the weighted one counts its weight. how goes to the fit.
    """
    wanted = commits.signatures(spark, {".gbk": genomes, ".hits": hit_folder}, ".gbk", (clans, ontology_path, mapping_path), f"{evalue}|{non_go}|{sorted(how.items())}")
    store = commits.Batches(spark, f"{out}/fit")
    todo = staged(store.todo(wanted, force), "todo")
    if not todo.isEmpty():
        kept, molecules = annotated(spark, todo, genomes, hit_folder, clans, evalue)
        terms = ontology.biological_processes(text.ontology_terms(spark.read.option("lineSep", "\n\n").text(ontology_path)))
        process = ontology.process_domains(text.domain_terms(spark.read.text(mapping_path)), terms)
        genes = hits.gene_domains(kept)
        distances = staged(mixture.pair_distances(ontology.go_gene_pairs(kept, process), genes), "distances")
        halves = hits.main_molecules(molecules).select("organism_id", (F.col("length") / 2.0).alias("half"))
        shared = staged(mixture.histogram(distances).join(halves, "organism_id"), "histogram")
        more = {"non_go": mixture.other_pairs_histogram(mixture.all_pairs_histogram(genes), shared)} if non_go else {}
        store.write(todo, params=mixture.em_fit(shared, **how).where("not isnan(rate)"), go=distances.select("organism_id", "gene1", "gene2", "distance"), histogram=shared, **more)
    params = staged(store.read("params", wanted), "params")
    mean = mixture.means(params)
    if newick is not None:
        nodes = tree.numbered(text.newick_tree(spark, newick))
        weights = tree.closure_weights(tree.subclade_scores(nodes, nodes.agg(F.max("depth")).first()[0])).where("subclade_id = 0")
        mean = mixture.weighted_means(params, weights)
        sinks.write_weights(weights, f"{out}/weights")
    sinks.write_parameters(params, mean, f"{out}/parameters")
    return mean


def sensitivity(spark: SparkSession, out: str) -> DataFrame:
    """How far the mean parameters agree with each organism's own, from what fit stored; stored and returned."""
    store = commits.Batches(spark, f"{out}/fit")
    wanted = _latest(spark, f"{out}/fit")
    mean = stored.parameters(spark, f"{out}/parameters/mean")
    mixture.agreement(store.read("histogram", wanted), store.read("params", wanted), mean).write.mode("overwrite").parquet(f"{out}/sensitivity")
    return spark.read.parquet(f"{out}/sensitivity")


def bootstrap_parameters(spark: SparkSession, out: str, weighted: bool = False, samples: int = 1_000_000) -> DataFrame:
    """Spread of the mean parameters over resampled organisms, from what fit stored; stored and returned."""
    params = stored.organism_parameters(spark, f"{out}/parameters/organisms")
    if weighted:
        params = params.join(stored.root_weights(spark, f"{out}/weights"), "organism_id")
    found = resample.bootstrap_summary(resample.bootstrap_means(params, ["rate", "phi"], samples, weight="weight" if weighted else None))
    found.write.mode("overwrite").parquet(f"{out}/bootstrap")
    return spark.read.parquet(f"{out}/bootstrap")


def permute(spark: SparkSession, out: str, weighted: bool = False, n_perm: int = 10_000, force: bool = False, **how) -> DataFrame:
    """Statistics of permuted pairs for all bins that have none yet; returns all that are stored."""
    table = spark.read.parquet(f"{out}/conserved")
    nodes = staged(text.labelled_tree(spark, spark.read.text(f"{out}/tree").first()[0]), "tree")
    height = nodes.agg(F.max("depth")).first()[0]
    store, wanted = commits.Batches(spark, f"{out}/likelihoods"), _latest(spark, f"{out}/likelihoods")
    members = staged(tree.closure_weights(tree.subclade_scores(nodes, height)).join(wanted.select("organism_id"), "organism_id", "left_semi"), "members")

    def run(bins: DataFrame) -> DataFrame:
        found = resample.permutations(bins, members, store.read("pool", wanted), store.read("uniform", wanted), lambda x: tree.pair_distances(x, nodes, height), n_perm=n_perm, weights=members if weighted else None, **how)
        return resample.summary(found, ["subclade_id", "bin"])

    return _by_bins(spark, table, f"{out}/permutations", force, run)


def resample_bins(spark: SparkSession, out: str, samples: int = 10_000, force: bool = False, **how) -> DataFrame:
    """Statistics of resampled pairs for all bins that have none yet; returns all that are stored."""
    table = spark.read.parquet(f"{out}/conserved")

    def run(bins: DataFrame) -> DataFrame:
        return resample.bin_bootstrap(table, samples, **how).join(bins.select("subclade_id", "bin"), ["subclade_id", "bin"], "left_semi")

    return _by_bins(spark, table, f"{out}/bin_bootstrap", force, run)


def _by_bins(spark: SparkSession, table: DataFrame, path: str, force: bool, run) -> DataFrame:
    """Runs what is left of the table's bins and appends it; with force all, in place of what is stored."""
    bins = resample.bin_counts(table).select(F.col("subclade_id").cast("long").alias("subclade_id"), "bin")
    try:
        done = None if force else stored.finished_bins(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    todo = staged(bins if done is None else sinks.todo(bins, done, ["subclade_id", "bin"]), "bins")
    if not todo.isEmpty():
        rows = staged(run(todo), "statistics")
        sinks.append_statistics(rows, path, "overwrite" if force else "append")
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").option("inferSchema", True).csv(path)


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """The organisms of a store with the signatures of their newest results."""
    return spark.read.parquet(f"{folder}/done").groupBy("organism_id").agg(F.max_by("signature", "at").alias("signature"))
