"""Conserved pairs of every subclade, and pruning of each pair to the nodes where it is shared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import posterior
from ..sources.scratch import staged
from .likelihood import PHI, conserved
from .tree import gathered, leaps, subclade_scales, times


def conserved_subclades(pairs: DataFrame, uniform: DataFrame, closure: DataFrame, weighted: bool = False, phi: float = PHI) -> DataFrame:
    weights = closure.select("organism_id", "subclade_id", (F.col("weight") if weighted else F.lit(1.0)).alias("weight"))
    return conserved(pairs, uniform, weights, ("subclade_id",), phi)


def rolled_up(pairs: DataFrame, uniform: DataFrame, tree: DataFrame, height: int, phi: float = PHI, weighted: bool = False) -> DataFrame:
    """conserved_subclades with every node's sums made of its descendants' in doubling rounds.

    The leaves' own rows are stored once and only read again: their sums at the parents are made before any
    shuffle of them, and each round shuffles the distinct pairs of inner nodes. pairs has one row an organism and pair.
    With weighted, an organism's weight at a node is a line in its score there, and scores change by one
    factor a node on their way up; so the sums of value times score and of the values give the weighted sum.
    At a leaf itself the weight is 1.
    """
    counts = ["occurrences", "fusions", "n_genes1", "n_genes2", "n_organisms"]
    logs = {"log_exp": F.col("exp_prob"), "log_uni": F.col("occurrences") * F.col("log_uni_prob")}
    nodes, scales = subclade_scales(tree, height) if weighted else (tree.withColumns({"own": F.lit(1.0), "share": F.lit(1.0)}), None)
    leaves = nodes.where("is_leaf").select("node_id", "parent_id", "organism_id", "own", "share").join(uniform, "organism_id")
    rows = pairs.join(leaves, "organism_id").withColumn("n_organisms", F.lit(1).cast("long"))
    columns = {c: (F.sum, None) for c in (*logs, *counts)}
    scored = {f"scored_{n}": n for n in logs} if weighted else {}
    columns |= {n: (F.sum, F.col(n) * F.col("factor")) for n in scored}
    steps = leaps(nodes, height, factor=(F.col("share"), times)) if weighted else leaps(nodes, height)
    pair = ("domain1", "domain2")
    kept = ["node_id", "parent_id", *pair, *[c.alias(n) for n, c in logs.items()], *counts]
    rows = staged(rows.select(*kept, *[(F.col("own") * F.col("share")).alias("own")] if weighted else []), "leaf_pairs")
    up = rows.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), *pair, *logs, *counts, *[(F.col("own") * F.col(n)).alias(s) for s, n in scored.items()])
    inner = gathered(up, steps, pair, columns)
    if weighted:
        inner = inner.join(scales, "node_id").withColumns({n: F.col("slope") * F.col(s) + F.col("base") * F.col(n) for s, n in scored.items()})
    inner = staged(inner.select("node_id", *pair, *logs, *counts), "inner_pairs")
    found = rows.select("node_id", *pair, *logs, *counts).unionByName(inner).where("occurrences > 0").withColumnRenamed("node_id", "subclade_id")
    return found.withColumn("prob", posterior(F.col("log_exp"), F.col("log_uni"), phi))


def require_leaves(pairs: DataFrame, tree: DataFrame) -> None:
    """Raises an error if a leaf of the tree has no pairs (strict mode)."""
    missing = tree.where("is_leaf").select("organism_id").join(pairs.select("organism_id"), "organism_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"leaves without data, such as {[r['organism_id'] for r in missing]}")


def pruning_counts(table: DataFrame, pruned: DataFrame) -> DataFrame:
    """Rows before pruning, kept and deleted, by subclade; pruned are rows of table, each once."""
    both = table.select("subclade_id", F.lit(0).alias("kept")).unionByName(pruned.select("subclade_id", F.lit(1).alias("kept")))
    return both.groupBy("subclade_id").agg(F.count_if(F.col("kept") == 0).alias("n_before"), F.count_if(F.col("kept") == 1).alias("n_kept")).withColumn("n_deleted", F.col("n_before") - F.col("n_kept"))


def child_maxima(table: DataFrame, tree: DataFrame) -> DataFrame:
    """Most occurrences of each pair in a child of each node, and the number of children that have it."""
    up = tree.select(F.col("node_id").alias("subclade_id"), "parent_id").where("parent_id is not null")
    return table.join(up, "subclade_id").groupBy(F.col("parent_id").alias("subclade_id"), "domain1", "domain2").agg(F.max("occurrences").alias("child_max"), F.count("*").alias("n_children"))


def split_flags(table: DataFrame, tree: DataFrame) -> DataFrame:
    """Whether a pair is split at an inner node: no child has all of its occurrences."""
    inner = tree.where("not is_leaf").select(F.col("node_id").alias("subclade_id"))
    rows = table.join(inner, "subclade_id").join(child_maxima(table, tree), ["subclade_id", "domain1", "domain2"], "left")
    return rows.select("subclade_id", "domain1", "domain2", (F.coalesce("child_max", F.lit(0)) != F.col("occurrences")).alias("is_split"))


def prune(table: DataFrame, tree: DataFrame, height: int) -> DataFrame:
    """Keeps leaves as they are, and inner rows with a split at or above them.

    A row keeps its counts and takes the probability of the deepest node at or above it at which its pair
    is split; rows without one go. A row that is not split points to its pair's row at the parent, and in
    each round to where that one points, so that the rounds are as many as the height has binary digits.
    """
    pair = ["domain1", "domain2"]
    up = tree.where("not is_leaf").select(F.col("node_id").alias("subclade_id"), "parent_id")
    flags = split_flags(table, tree)
    state = table.select("subclade_id", *pair, "prob").join(flags, ["subclade_id", *pair]).join(up, "subclade_id")
    state = state.select("subclade_id", *pair, F.when(~F.col("is_split"), F.col("parent_id")).alias("at"), F.when(F.col("is_split"), F.col("prob")).alias("pruned"))
    for _ in range(max(height - 1, 0).bit_length()):
        state = staged(state, "pruning")
        above = state.toDF("at", *pair, "at_", "pruned_")
        open_rows = state.where("at is not null").join(above, ["at", *pair], "left").select("subclade_id", *pair, F.col("at_").alias("at"), F.col("pruned_").alias("pruned"))
        state = state.where("at is null").unionByName(open_rows)
    kept = table.join(state.where("pruned is not null").select("subclade_id", *pair, "pruned"), ["subclade_id", *pair]).withColumn("prob", F.col("pruned")).drop("pruned")
    leaves = tree.where("is_leaf").select(F.col("node_id").alias("subclade_id"))
    return kept.unionByName(table.join(leaves, "subclade_id", "left_semi"))
