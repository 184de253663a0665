"""Jobs from files to stored tables, which go on where an earlier run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hits, likelihood, ontology, pairs, subclades, tree
from ..sources import commits, sinks, text
from ..sources.scratch import staged


def build_mappings(spark: SparkSession, ontology_path: str, mapping_path: str, out: str) -> None:
    """From the ontology and the domain-to-term file to the stored terms, mapping and lists."""
    terms = ontology.biological_processes(text.ontology_terms(spark.read.option("lineSep", "\n\n").text(ontology_path)))
    sinks.write_ontology(terms, ontology.process_domains(text.domain_terms(spark.read.text(mapping_path)), terms), out)


def annotated(spark: SparkSession, organisms: DataFrame, genomes: str, hit_folder: str, clans: str, evalue: float) -> tuple[DataFrame, DataFrame]:
    """The kept hits of some organisms, stored, and their molecules."""
    ids = organisms.select("organism_id")
    genes = text.coding_genes(text.files(spark, genomes, ".gbk", line_sep="\n//")).join(ids, "organism_id", "left_semi")
    found = text.domain_hits(text.files(spark, hit_folder, ".hits").join(ids, "organism_id", "left_semi")).withColumn("line_no", F.monotonically_increasing_id())
    molecules = genes.select("organism_id", "molecule_id", "length").distinct()
    return staged(hits.resolve_clans(hits.filter_hits(found, genes, molecules, evalue), text.clan_table(spark.read.text(clans))), "kept"), molecules


def predict(
    spark: SparkSession, genomes: str, hit_folder: str, clans: str, out: str, newick: str | None = None, evalue: float = 0.001, rate: float = likelihood.LAMBDA, phi: float = likelihood.PHI,
    weighted: bool = False, force: bool = False, strict: bool = False,
) -> DataFrame:
    """From annotated genomes, domain hits and the clan table to the stored conserved pairs, which it returns.

    Organisms whose likelihoods are stored are not computed again unless force is given or their files, the
    clan table or the settings have changed; organisms whose files are gone don't count. The sums over
    organisms are computed anew, since each organism changes them. A run that ends early is made good by
    the next one. With a tree, all subclades are computed and pruned (weighted by the tree on request), else
    the root alone. An organism without hits on its main molecule is left out; with strict and a tree, a leaf
    without pairs is an error.
    """
    wanted = commits.signatures(spark, {".gbk": genomes, ".hits": hit_folder}, ".gbk", (clans,), f"{evalue}|{rate}")
    store = commits.Batches(spark, f"{out}/likelihoods")
    todo = staged(store.todo(wanted, force), "todo")
    if not todo.isEmpty():
        kept, molecules = annotated(spark, todo, genomes, hit_folder, clans, evalue)
        own = likelihood.organism_likelihoods(pairs.nearest_pairs(hits.gene_domains(kept)), hits.domain_gene_counts(kept), rate)
        sinks.write_probabilities(todo, own, likelihood.uniform_log_probabilities(hits.main_molecules(molecules)), f"{out}/likelihoods", pool=hits.gene_pool(kept))

    own, uniform = (staged(store.read(x, wanted), x) for x in ("pairs", "uniform"))
    sinks.write_pair_index(pairs.pair_index(own), f"{out}/pair_index")
    if newick is None:
        table = likelihood.conserved(own, uniform, phi=phi).withColumn("subclade_id", F.lit(0).cast("long"))
    else:
        nodes = tree.numbered(text.newick_tree(spark, newick))
        if strict:
            subclades.require_leaves(own, nodes)
        height = nodes.agg(F.max("depth")).first()[0]
        closure = tree.closure_weights(tree.subclade_scores(nodes, height))
        sinks.write_composition(closure, f"{out}/composition", "overwrite")
        sinks.write_weights(closure, f"{out}/weights")
        sinks.write_labelled_newick(nodes, f"{out}/tree")
        every = subclades.rolled_up(own, uniform, nodes, height, phi, weighted)
        table = subclades.prune(every, nodes, height)
    sinks.write_conserved(table, f"{out}/conserved", "overwrite")
    return spark.read.parquet(f"{out}/conserved")
