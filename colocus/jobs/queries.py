"""Queries over the bound tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as h
from ..operators import fit, hits, likelihood, ontology, pairs, resample, subclades, tree
from ..sources.binding import Genomes
from ..sources.scratch import staged

EVALUE, RATE, PHI, HEIGHT = 0.001, likelihood.LAMBDA, likelihood.PHI, 3


class Flow:
    """The tables that the queries share, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.g = spark, sf_dir, Genomes(spark, sf_dir)

    main = cached_property(lambda s: hits.main_molecules(s.g.molecules()))
    filtered = cached_property(lambda s: hits.filter_hits(s.g.hits(), s.g.genes(), s.g.molecules(), EVALUE))
    kept = cached_property(lambda s: staged(hits.resolve_clans(s.filtered, s.g.clans()), "kept"))
    genes = cached_property(lambda s: hits.gene_domains(s.kept))
    counts = cached_property(lambda s: hits.domain_gene_counts(s.kept))
    distances = cached_property(lambda s: pairs.gene_pair_distances(s.genes))
    closest = cached_property(lambda s: pairs.nearest_pairs(s.genes))
    organism = cached_property(lambda s: likelihood.organism_likelihoods(pairs.nearest_pairs(s.genes, counted=True), rate=RATE))
    uniform = cached_property(lambda s: likelihood.uniform_log_probabilities(s.main))
    process = cached_property(lambda s: ontology.process_domains(s.g.go_domain(), s.g.go_terms()))
    go_pairs = cached_property(lambda s: ontology.go_gene_pairs(s.kept, s.process))
    go_distances = cached_property(lambda s: fit.pair_distances(s.go_pairs, s.genes))
    lineages = cached_property(lambda s: s.g.lineages(s.kept))
    tree = cached_property(lambda s: staged(tree.lineage_tree(staged(s.lineages, "lineages")), "tree"))
    scores = cached_property(lambda s: tree.subclade_scores(s.tree, HEIGHT))
    closure = cached_property(lambda s: staged(tree.closure_weights(s.scores), "closure"))
    root = cached_property(lambda s: s.closure.where("subclade_id = 0"))
    subclades = cached_property(lambda s: subclades.rolled_up(s.organism, s.uniform, s.tree, HEIGHT))
    weighted = cached_property(lambda s: subclades.rolled_up(s.organism, s.uniform, s.tree, HEIGHT, weighted=True))
    pruned = cached_property(lambda s: subclades.prune(s.subclades, s.tree, HEIGHT))
    halves = cached_property(lambda s: s.main.select("organism_id", (F.col("length") / 2.0).alias("half")))
    org_histogram = cached_property(lambda s: staged(fit.histogram(s.go_distances).join(s.halves, "organism_id"), "histogram"))
    org_step = cached_property(lambda s: staged(fit.em_step(s.org_histogram, RATE, PHI), "step"))
    fitted = cached_property(lambda s: staged(fit.em_fit(s.org_histogram).where("not isnan(rate)"), "fitted"))

    @cached_property
    def nation_histogram(self) -> DataFrame:
        rows = self.go_distances.join(self.lineages.select("organism_id", "nation"), "organism_id")
        return fit.histogram(rows, "nation").withColumn("half", F.lit(20000.0))

    @cached_property
    def nation_params(self) -> DataFrame:
        return fit.em_step(self.nation_histogram, RATE, PHI, "nation")

    zetas = cached_property(lambda s: fit.responsibilities(s.org_histogram, RATE, PHI))
    agreement = cached_property(lambda s: fit.agreement(s.org_histogram, s.org_step, fit.means(s.org_step)))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _near(name: str, digits: int = 6):
    """_r for values of at least 0 and below 10**12, without decimals for each row."""
    return (F.floor(F.col(name) * 10.0**digits + 0.5) / 10.0**digits).alias(name)


CONSERVED = ["domain1", "domain2", "occurrences", "fusions", "n_genes1", "n_genes2", "n_organisms"]


def _conserved(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *CONSERVED, _r("log_exp", 4), _r("log_uni", 4), _r("prob"))


def overlapping(f: Flow) -> DataFrame:
    return pairs.overlapping_genes(f.genes)


def prob_code(f: Flow) -> DataFrame:
    p = F.round(F.col("evalue") * 40000 / 500, 4)
    rows = f.g.hits().select("gene_id", "line_no", F.least(p, F.lit(1.0)).alias("p"))
    code = h.probability_code(F.col("p"))
    return rows.select("gene_id", "line_no", "p", code.alias("code"), F.round(h.decoded_probability(code), 9).alias("decoded"))


def incremental_todo(f: Flow) -> DataFrame:
    """Organisms with pairs that are not among those of the first regions done before."""
    done = f.lineages.where("region < 2").select("organism_id")
    return f.organism.select("organism_id").distinct().join(done, "organism_id", "left_anti")


def weighted_param_mean(f: Flow) -> DataFrame:
    return fit.weighted_means(f.org_step, f.root).select(F.round("rate", 9).alias("rate"), _r("phi"))


def leaf_distances(f: Flow, norm: bool = False) -> DataFrame:
    """All pairs of leaves."""
    d = tree.leaf_distances(f.tree, HEIGHT)
    return tree.normalised(d, top=tree.diameter(f.tree, HEIGHT)).select("organism1", "organism2", _near("norm_distance")) if norm else d.select("organism1", "organism2", _near("distance"))


def permutation_draws(f: Flow, weighted: bool = False, **how) -> DataFrame:
    """Permutations of all bins of all subclades, as many as the operator makes unless how says otherwise."""
    bins = resample.bin_counts(f.subclades)
    return resample.permutations(bins, f.closure, hits.gene_pool(f.kept), f.uniform, lambda drawn: tree.pair_distances(drawn, f.tree, HEIGHT), weights=f.closure if weighted else None, **how)


def few_permutations(f: Flow, weighted: bool = False) -> DataFrame:
    """The first permutations of every bin as they are, few enough for SQL to follow draw by draw."""
    found = permutation_draws(f, weighted, n_perm=FEW_PERMUTATIONS)
    return found.select("subclade_id", "bin", "perm", _r("log_exp", 3), _r("log_uni", 3), _r("moved"), _r("prob"))


FEW_PERMUTATIONS, FEW_SAMPLES, EM_ROUNDS = 2, 300, 25


def permutation_stats(f: Flow) -> DataFrame:
    s = resample.summary(permutation_draws(f), ["subclade_id", "bin"])
    return s.select("subclade_id", "bin", "n", *[_r(c) for c in ("e_4", "e_3", "mean", "median", "pct_above", "moved")])


def permutation_heatmap(f: Flow) -> DataFrame:
    sizes = f.closure.groupBy("subclade_id").agg(F.count("*").alias("n_members"))
    return resample.heatmap(resample.summary(permutation_draws(f), ["subclade_id", "bin"]), sizes, HEAT_BINS)


def own_values(f: Flow) -> DataFrame:
    """The organisms' own parameters as rows of parameter and mean, as bootstrap_means gives them."""
    sound = f.org_step.where("rate > 0 and not isnan(rate)")
    return sound.unpivot(["organism_id"], ["rate", "phi"], "parameter", "mean").select("parameter", "mean")


def param_spread(f: Flow) -> DataFrame:
    return resample.bootstrap_summary(own_values(f)).select("parameter", *[_r(c, 9) for c in ("mean", "sd", "p2_5", "p97_5")])


def param_histogram(f: Flow) -> DataFrame:
    return resample.histogram_of(own_values(f)).select("parameter", "bin", _r("low", 9), "n", _r("density", 3))


def fitted_density(f: Flow) -> DataFrame:
    """Of the organisms' own step of the fit, which SQL can follow."""
    return fit.fitted_density(f.org_step.join(f.halves, "organism_id")).select("organism_id", "point", _r("distance", 3), _r("density", 10))


HEAT_BINS = [1, 5, 10, 50, 100, 500, 1000, 5000, 10_000, 50_000, 100_000]


def observed_bins(f: Flow) -> DataFrame:
    return resample.observed_bins(f.subclades).select("subclade_id", "bin", "n", *[_r(c) for c in ("e_4", "e_3", "mean", "median", "pct_above", "statistic", "fraction")])


def observed_heatmap(f: Flow) -> DataFrame:
    sizes = f.closure.groupBy("subclade_id").agg(F.count("*").alias("n_members"))
    return resample.heatmap(resample.observed_bins(f.subclades), sizes, HEAT_BINS).select("n_members", *[F.round(F.col(f"`{b}`"), 6).alias(str(b)) for b in HEAT_BINS])


def param_bootstrap(f: Flow) -> DataFrame:
    """Resamples of the organisms' fitted parameters, weighted as in the root."""
    return resample.bootstrap_summary(resample.bootstrap_means(f.fitted.join(f.root.select("organism_id", "weight"), "organism_id"), ["rate", "phi"], weight="weight"))


def step_bootstrap(f: Flow, samples: int, weight: str | None) -> DataFrame:
    """Resamples of the organisms' own step of the fit, which SQL can follow."""
    sound = f.org_step.where("rate > 0 and not isnan(rate)").join(f.root.select("organism_id", "weight"), "organism_id")
    return resample.bootstrap_means(sound, ["rate", "phi"], samples, weight=weight).select("sample", "parameter", _r("mean", 8))


def fitted_means(f: Flow) -> DataFrame:
    """Plain and weighted means of the organisms' fitted parameters, and what their own agree with."""
    return fit.means(f.fitted).withColumn("kind", F.lit("plain")).unionByName(fit.weighted_means(f.fitted, f.root).withColumn("kind", F.lit("weighted")))


_FLOW: dict[str, Callable[[Flow], DataFrame]] = {
    "main_molecule": lambda f: f.main,
    "hits_filtered": lambda f: f.filtered.select("organism_id", "gene_id", "domain_id", _r("evalue"), "line_no"),
    "clan_resolved": lambda f: f.kept.select("organism_id", "gene_id", "domain_id", "clan_id", "line_no"),
    "domain_gene_counts": lambda f: f.counts,
    "domain_pairs": lambda f: pairs.domain_pairs(f.kept),
    "gene_pair_distances": lambda f: f.distances,
    "overlapping_genes": overlapping,
    "fusions": lambda f: pairs.fusions(f.distances),
    "closest_pairs": lambda f: f.closest,
    "organism_pair_likelihood": lambda f: f.organism.select("organism_id", "domain1", "domain2", _r("exp_prob", 5), "occurrences", "fusions", "n_genes1", "n_genes2"),
    "uniform_prob": lambda f: f.uniform.select("organism_id", _r("log_uni_prob")),
    "conserved_root": lambda f: _conserved(likelihood.conserved(f.organism, f.uniform, phi=PHI)),
    "prob_code": prob_code,
    "pair_index": lambda f: pairs.pair_index(f.organism),
    "pair_lookup": lambda f: f.organism.join(pairs.pair_index(f.organism), ["domain1", "domain2"]).select("organism_id", "pair_id", "occurrences"),
    "pair_keys": lambda f: f.organism.select("domain1", "domain2").distinct().select("domain1", "domain2", h.pair_key(F.format_string("PF%05d", "domain1"), F.format_string("PF%05d", "domain2")).alias("pair_key")),
    "go_terms_bp": lambda f: ontology.biological_processes(f.g.go_terms()),
    "go_semi_join": lambda f: f.process,
    "go_domain_lists": lambda f: ontology.mapping_lists(f.process, "go_id", "domain_id").select("go_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members")),
    "go_gene_pairs": lambda f: f.go_pairs,
    "go_pair_annotations": lambda f: ontology.go_pair_annotations(f.kept, f.process).select("organism_id", "gene1", "gene2", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("go_ids", "domain_ids")]),
    "non_go_pairs": lambda f: ontology.non_go_pairs(f.kept, f.process),
    "non_go_distance_histogram": lambda f: fit.other_pairs_histogram(fit.all_pairs_histogram(f.genes), fit.histogram(f.go_distances)),
    "go_distance_histogram": lambda f: fit.histogram(f.go_distances),
    "distance_bins": lambda f: fit.binned(f.go_distances).select("bin", "n", F.round("density", 10).alias("density")),
    "em_one_step": lambda f: f.nation_params.select("nation", F.round("rate", 9).alias("rate"), _r("phi"), _r("log_likelihood", 3), "n_pairs"),
    "em_rounds": lambda f: fit.em_run(f.org_histogram, RATE, PHI, EM_ROUNDS).select("organism_id", F.round("rate", 8).alias("rate"), _r("phi"), _r("log_likelihood", 4), "rounds"),
    "em_fit": lambda f: f.fitted,
    "fitted_means": fitted_means,
    "fitted_sensitivity": lambda f: fit.agreement(f.org_histogram, f.fitted, fit.means(f.fitted)),
    "genes_in_either": lambda f: pairs.genes_in_either(f.counts, f.distances),
    "pruning_counts": lambda f: subclades.pruning_counts(f.subclades, f.pruned),
    "domain_go_lists": lambda f: ontology.mapping_lists(f.process, "domain_id", "go_id").select("domain_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members")),
    "unmatched_hits": lambda f: hits.unmatched_hits(f.g.hits(), f.g.genes().where("gene_id % 7 <> 0")).select("organism_id", "gene_id", "domain_id", "line_no"),
    "conserved_sum_check": lambda f: _conserved(subclades.conserved_subclades(f.organism, f.uniform, f.closure.where("subclade_id = 0")), "subclade_id"),
    "zetas": lambda f: f.zetas.select("organism_id", "distance", "n", _r("zeta")),
    "sensitivity_rates": lambda f: f.agreement.select("organism_id", "n_own", _r("tpr"), _r("fpr")),
    "zeta_corr": lambda f: f.agreement.select("organism_id", F.round(F.nanvl("corr", F.lit(None)), 4).alias("corr")),
    "weighted_param_mean": weighted_param_mean,
    "tree_nodes": lambda f: f.tree.select("node_id", "parent_id", _r("dist"), "organism_id", "is_leaf", "depth"),
    "subclade_ids": lambda f: f.tree.where("not is_leaf").select(F.col("node_id").alias("subclade_id"), "region", "nation", "bfs_idx"),
    "closure": lambda f: f.closure.select("subclade_id", "organism_id"),
    "gsc_weights": lambda f: f.closure.select("subclade_id", "organism_id", _r("score"), _r("weight")),
    "gsc_mean_one": lambda f: f.closure.select("subclade_id", "organism_id", _r("mean_one")),
    "conserved_weighted": lambda f: _conserved(likelihood.conserved(f.organism, f.uniform, f.root, phi=PHI)),
    "conserved_subclades": lambda f: _conserved(f.subclades, "subclade_id"),
    "conserved_subclades_weighted": lambda f: _conserved(f.weighted, "subclade_id"),
    "pair_split": lambda f: subclades.split_flags(f.subclades, f.tree),
    "pruned_subclades": lambda f: f.pruned.select("subclade_id", *CONSERVED, _r("prob")),
    "occurrence_bins": lambda f: f.organism.groupBy("domain1", "domain2").agg(F.sum("occurrences").alias("occurrences")).select("domain1", "domain2", "occurrences", h.single_bin(F.col("occurrences")).alias("single_bin"), F.array_join(h.occurrence_bins(F.col("occurrences")).cast("array<string>"), ",").alias("bins")),
    "bin_pairs": lambda f: resample.bin_counts(f.subclades).select("subclade_id", "bin", "n_pairs", _r("mean_prob", 5)),
    "leaf_distances": lambda f: leaf_distances(f),
    "leaf_distances_normalised": lambda f: leaf_distances(f, True),
    "gene_pool": lambda f: hits.gene_pool(f.kept).select("organism_id", "gene_idx", "gene_id", "gene_start", "gene_end", "size", _r("weight")),
    "branch_length_sum": lambda f: tree.branch_sums(f.tree, HEIGHT).select("node_id", _r("branch_length", 6), _r("scaled", 5)),
    "param_bootstrap": param_bootstrap,
    "param_resamples": lambda f: step_bootstrap(f, FEW_SAMPLES, None),
    "param_resamples_weighted": lambda f: step_bootstrap(f, FEW_SAMPLES, "weight"),
    "param_spread": param_spread,
    "param_histogram": param_histogram,
    "fitted_density": fitted_density,
    "observed_bins": observed_bins,
    "observed_heatmap": observed_heatmap,
    "occurrence_slice": lambda f: resample.slice_of(f.subclades, [1, 5, 10]).select("subclade_id", *CONSERVED, _r("prob")),
    "bin_bootstrap": lambda f: resample.bin_bootstrap(f.subclades),
    "permutation_stats": permutation_stats,
    "permutation_heatmap": permutation_heatmap,
    "permutation_probs": few_permutations,
    "permutation_probs_weighted": lambda f: few_permutations(f, True),
    "missing_inputs": lambda f: hits.missing_inputs(f.g.molecules(), f.filtered),
    "incremental_todo": incremental_todo,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: (lambda spark, sf_dir, make=make: make(Flow(spark, sf_dir))) for name, make in _FLOW.items()
}
