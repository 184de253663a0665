"""Trees of organisms as edge tables: numbering, subclades, weights and distances.

A tree has node_id, parent_id (null at the root), dist, organism_id (leaves only), is_leaf and depth.
Whatever goes along paths or up subtrees takes as many rounds as the height has binary digits: each round
doubles how far a node looks up, so that a tree of depth 2,000 takes 11 of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import scaled_weight
from ..sources.scratch import staged
from .pairs import all_pairs, dense_index

#: The smallest positive double of full precision, for leaves without a branch.
SMALLEST = 2.2250738585072014e-308


def leaps(tree: DataFrame, height: int, **values: tuple[Column, Callable[[Column, Column], Column]]) -> list[DataFrame]:
    """For each round k, every node with its ancestor 2**k levels up: node_id, up_id and the values of the path.

    A value is a column of the tree for one step up, and how two paths' values make one. Nodes that have no
    such ancestor are left out. A path holds its lower node's step but not its upper node's.
    """
    out = [tree.where("parent_id is not null").select("node_id", F.col("parent_id").alias("up_id"), *[c.alias(n) for n, (c, _) in values.items()])]
    for k in range(1, max(height, 0).bit_length()):
        low, high = out[-1], out[-1].toDF("up_id", "up2_id", *[f"{n}_" for n in values])
        both = low.join(high, "up_id").select("node_id", F.col("up2_id").alias("up_id"), *[join(F.col(n), F.col(f"{n}_")).alias(n) for n, (_, join) in values.items()])
        out.append(staged(both, "leaps") if k > 1 else both)
    return out if height > 0 else []


def gathered(rows: DataFrame, steps: list[DataFrame], keys: tuple[str, ...], columns: dict[str, tuple[Callable, Column | None]]) -> DataFrame:
    """Every node's aggregates over the rows of all nodes at or below it, by keys.

    rows has node_id, keys and columns. A column has its aggregate and, where a value changes on its way up,
    what becomes of it over a leap. Each round merges what is within twice the distance.
    """
    names = ["node_id", *keys]
    now = rows.groupBy(*names).agg(*[agg(c).alias(c) for c, (agg, _) in columns.items()])
    for step in steps:
        now = staged(now, "gathered")
        up = now.join(step, "node_id").select(F.col("up_id").alias("node_id"), *keys, *[(F.col(c) if moved is None else moved).alias(c) for c, (_, moved) in columns.items()])
        now = now.unionByName(up).groupBy(*names).agg(*[agg(c).alias(c) for c, (agg, _) in columns.items()])
    return now


def add(a: Column, b: Column) -> Column:
    return a + b


def times(a: Column, b: Column) -> Column:
    return a * b


def lineage_tree(lineages: DataFrame) -> DataFrame:
    """The tree of region, nation and organism, numbered in reversed level order with the root as 0."""
    none, long = F.lit(None), "long"
    root = lineages.select(F.lit(0).alias("depth"), none.cast("int").alias("region"), none.cast("int").alias("nation"), none.cast(long).alias("organism_id"), F.lit(0.0).alias("dist")).distinct()
    regions = lineages.select(F.lit(1).alias("depth"), "region", none.cast("int").alias("nation"), none.cast(long).alias("organism_id"), F.col("region_dist").alias("dist")).distinct()
    nations = lineages.select(F.lit(2).alias("depth"), "region", "nation", none.cast(long).alias("organism_id"), F.col("nation_dist").alias("dist")).distinct()
    leaves = lineages.select(F.lit(3).alias("depth"), "region", "nation", "organism_id", F.col("leaf_dist").alias("dist"))
    nodes = _numbered(reduce(DataFrame.union, (root, regions, nations, leaves)))
    up = nodes.select(F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.col("region").alias("pr"), F.col("nation").alias("pn")).where("depth <= 3")
    met = (F.col("n.depth") == F.col("p.depth")) & ((F.col("n.depth") < 2) | (F.col("n.region") == F.col("p.pr"))) & ((F.col("n.depth") < 3) | (F.col("n.nation") == F.col("p.pn")))
    return nodes.alias("n").join(up.alias("p"), met, "left").select("n.node_id", "p.parent_id", "n.dist", "n.organism_id", (F.col("n.depth") == 3).alias("is_leaf"), "n.depth", "n.bfs_idx", "n.region", "n.nation")


def _numbered(nodes: DataFrame) -> DataFrame:
    keyed = nodes.withColumns({"region_": F.coalesce("region", F.lit(-1)), "nation_": F.coalesce("nation", F.lit(-1))})
    indexed = dense_index(keyed, ["depth", "region_", "nation_"], ["organism_id"], "bfs_idx").drop("region_", "nation_")
    total = indexed.agg(F.count("*").alias("total_"))
    return indexed.join(F.broadcast(total)).withColumn("node_id", F.when(F.col("bfs_idx") == 0, 0).otherwise(F.col("total_") - F.col("bfs_idx"))).drop("total_")


def numbered(edges: DataFrame) -> DataFrame:
    """An edge table (node_id, parent_id, dist, organism_id, is_leaf, depth) of any depth, numbered as subclades.

    Nodes are counted by level and within a level in the order of their paths from the root, children in
    the order of their old numbers; the root is 0 and node k of N is N - k. Adds bfs_idx. The result
    is stored, as all that is made of a tree reads it many times. An empty table gives an empty result.

    Paths are in the order of the nodes' first visits, and a node's visit comes after its parent's by one and
    the sizes of the siblings before it: sizes go up the tree, visits down it, in doubling rounds.
    """
    height = edges.agg(F.max("depth")).first()[0] or 0
    rows = staged(edges, "edges")
    sizes = gathered(rows.select("node_id", F.lit(1).cast("long").alias("size")), leaps(rows, height), (), {"size": (F.sum, None)})
    earlier = F.sum("size").over(Window.partitionBy("parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    visit = staged(rows.join(sizes, "node_id").select("node_id", F.col("parent_id").alias("up_id"), F.when(F.col("parent_id").isNull(), 0).otherwise(1 + F.coalesce(earlier, F.lit(0))).cast("long").alias("visit")), "visits")
    for _ in range(height.bit_length()):
        up = visit.toDF("up_id", "up2_id", "visit_")
        visit = staged(visit.join(up, "up_id", "left").select("node_id", F.col("up2_id").alias("up_id"), (F.col("visit") + F.coalesce("visit_", F.lit(0))).alias("visit")), "visits")
    rows = rows.withColumnRenamed("node_id", "old").join(visit.select(F.col("node_id").alias("old"), "visit"), "old")
    rows = dense_index(rows, ["depth"], ["visit"], "bfs_idx").join(F.broadcast(rows.agg(F.count("*").alias("total_"))))
    rows = rows.withColumn("node_id", F.when(F.col("bfs_idx") == 0, 0).otherwise(F.col("total_") - F.col("bfs_idx")).cast("long"))
    up = rows.select(F.col("old").alias("parent_id"), F.col("node_id").alias("new_parent"))
    return staged(rows.join(up, "parent_id", "left").select("node_id", F.col("new_parent").alias("parent_id"), "dist", "organism_id", "is_leaf", "depth", "bfs_idx"), "numbered")


def with_shares(tree: DataFrame, height: int) -> DataFrame:
    """The tree with own, a leaf's score at itself, and share, by which a score grows where it leaves a node.

    An inner node's branch is shared among its leaves in proportion to their scores, which sum to all the
    branches below the node; so all of them grow by one factor. Leaves without a branch have the least length.
    """
    length = F.when(F.col("is_leaf") & (F.col("dist") == 0), SMALLEST).otherwise(F.col("dist"))
    below = gathered(tree.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), length.alias("below")), leaps(tree, height), (), {"below": (F.sum, None)})
    share = F.when(F.col("is_leaf"), 1.0).otherwise((F.col("below") + F.col("dist")) / F.nullif(F.col("below"), F.lit(0.0)))
    return staged(tree.join(below, "node_id", "left").select(*tree.columns, F.when(F.col("is_leaf"), length).alias("own"), share.alias("share")), "shares")


def subclade_scores(tree: DataFrame, height: int) -> DataFrame:
    """Every node with the leaves below it and their scores there: node_id, organism_id, score.

    A leaf's score at a node is its own branch's length times the shares of the inner nodes between. height is
    the depth of the deepest leaf.
    """
    shared = with_shares(tree, height)
    up = paths(shared, leaps(shared, height, factor=(F.col("share"), times)), factor=(F.lit(1.0), times))
    return up.join(shared.where("is_leaf").select("node_id", "organism_id", "own"), "node_id").select(F.col("ancestor_id").alias("node_id"), "organism_id", (F.col("own") * F.col("factor")).alias("score"))


def subclade_scales(tree: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """The tree with shares, and for every node the line that scales its leaves' scores: node_id, slope and base.

    weight = slope * score + base is what closure_weights gives, without the table of leaves in nodes: number,
    least and largest score of a node's leaves go up the tree.
    """
    shared = with_shares(tree, height)
    steps = leaps(shared, height, factor=(F.col("share"), times))
    moved = [F.col("factor") * F.col(c) for c in ("low", "high")]
    ends = gathered(shared.where("is_leaf").select("node_id", F.col("own").alias("low"), F.col("own").alias("high"), F.lit(1).cast("long").alias("n")), steps, (), {"low": (F.min, F.least(*moved)), "high": (F.max, F.greatest(*moved)), "n": (F.sum, None)})
    flat = (F.col("n") == 1) | (F.col("high") - F.col("low") < 1e-6)
    slope = F.when(flat, 0.0).otherwise((1 - 1 / F.col("n")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return shared, ends.select("node_id", slope.alias("slope"), F.when(flat, 1.0).otherwise(1 / F.col("n") - F.col("low") * slope).alias("base"))


def closure_weights(scores: DataFrame) -> DataFrame:
    """Membership of leaves in subclades with scaled weights and weights of mean 1."""
    w = Window.partitionBy("node_id")
    n = F.count("*").over(w)
    return scores.select(
        F.col("node_id").alias("subclade_id"), "organism_id", "score",
        scaled_weight(F.col("score"), F.min("score").over(w), F.max("score").over(w), n).alias("weight"),
        (F.col("score") / F.sum("score").over(w) * n).alias("mean_one"),
    )


def paths(tree: DataFrame, steps: list[DataFrame], **values: tuple[Column, Callable[[Column, Column], Column]]) -> DataFrame:
    """Every node with each of its ancestors and itself: node_id, ancestor_id, ancestor_depth and the path's values.

    steps are leaps of the same values; a value here has what a path of no step holds, and how two make one.
    """
    now = tree.select("node_id", F.col("node_id").alias("ancestor_id"), F.col("depth").alias("ancestor_depth"), *[c.alias(n) for n, (c, _) in values.items()])
    for k, step in enumerate(steps):
        further = now.toDF("up_id", "ancestor_id", "ancestor_depth", *[f"{n}_" for n in values])
        up = step.join(further, "up_id").select("node_id", "ancestor_id", "ancestor_depth", *[join(F.col(n), F.col(f"{n}_")).alias(n) for n, (_, join) in values.items()])
        now = now.unionByName(up)
        now = staged(now, "paths") if 0 < k < len(steps) - 1 else now
    return now


def ancestors(tree: DataFrame, height: int) -> DataFrame:
    """paths with span, the branch length between; negative lengths count as 0."""
    length = F.greatest("dist", F.lit(0.0))
    return paths(tree, leaps(tree, height, span=(length, add)), span=(F.lit(0.0), add))


def leaf_distances(tree: DataFrame, height: int, depth: int = 0) -> DataFrame:
    """Path lengths between the leaves below each node of the given depth, once for each pair.

    Two leaves meet at the deepest node above both, where they come from different children. The leaves of a node
    meet in blocks, so that only what is returned grows with the square of a node's leaves.
    """
    above = ancestors(tree, height).join(tree.where("is_leaf").select("node_id", "organism_id"), "node_id")
    child = above.select("node_id", (F.col("ancestor_depth") - 1).alias("ancestor_depth"), F.col("ancestor_id").alias("child"))
    arms = staged(above.where(F.col("ancestor_depth") >= depth).join(child, ["node_id", "ancestor_depth"]).select("ancestor_id", "child", "organism_id", "span"), "arms")
    met = all_pairs(arms, ["ancestor_id"], "organism_id").where("one.child <> two.child")
    return met.select(F.col("one.organism_id").alias("organism1"), F.col("two.organism_id").alias("organism2"), (F.col("one.span") + F.col("two.span")).alias("distance"))


def diameter(tree: DataFrame, height: int) -> DataFrame:
    """The longest path between two leaves, as top: at some node, the sum of its two longest arms."""
    length = F.greatest("dist", F.lit(0.0))
    arm = gathered(tree.where("is_leaf").select("node_id", F.lit(0.0).alias("arm")), leaps(tree, height, span=(length, add)), (), {"arm": (F.max, F.col("arm") + F.col("span"))})
    arms = tree.where("parent_id is not null").join(arm, "node_id").select("parent_id", "node_id", (F.col("arm") + length).alias("arm"))
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.desc("arm")))
    two = arms.withColumn("place", place).where("place <= 2").groupBy("parent_id").agg(F.sum("arm").alias("d"), F.count("*").alias("k")).where("k = 2")
    return two.agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("top"))


def pair_distances(pairs: DataFrame, tree: DataFrame, height: int, least: float = 1e-4) -> DataFrame:
    """The distances of pairs(organism1, organism2) of leaves, brought to [least, 1] as in normalised() over all leaves."""
    above = ancestors(tree, height).join(tree.where("is_leaf").select("node_id", "organism_id"), "node_id")
    a = above.select(F.col("organism_id").alias("organism1"), "ancestor_id", "ancestor_depth", F.col("span").alias("span1"))
    b = above.select(F.col("organism_id").alias("organism2"), "ancestor_id", F.col("span").alias("span2"))
    met = pairs.select("organism1", "organism2").distinct().join(a, "organism1").join(b, ["organism2", "ancestor_id"])
    found = met.groupBy("organism1", "organism2").agg(F.max_by(F.col("span1") + F.col("span2"), "ancestor_depth").alias("d"))
    share = F.coalesce(F.col("d") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0))
    return found.join(F.broadcast(diameter(tree, height))).select("organism1", "organism2", (share * (1 - least) + least).alias("norm_distance"))


def normalised(distances: DataFrame, least: float = 1e-4, top: DataFrame | None = None) -> DataFrame:
    """Distances brought to [least, 1]; the least distance is the 0 of a leaf to itself.

    top is the largest distance as the one row of diameter(), without which all distances are made twice.
    """
    d = F.greatest("distance", F.lit(0.0))
    top = (distances.agg(F.max(d)) if top is None else top).toDF("top_")
    return distances.join(F.broadcast(top)).withColumn("norm_distance", F.coalesce(d / F.nullif(F.col("top_"), F.lit(0.0)), F.lit(0.0)) * (1 - least) + least).drop("top_")


def branch_sums(tree: DataFrame, height: int) -> DataFrame:
    """Total branch length below each inner node, and the same brought to the range 0 to 1."""
    below = tree.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.greatest("dist", F.lit(0.0)).alias("branch_length"))
    sums = gathered(below, leaps(tree, height), (), {"branch_length": (F.sum, None)})
    ends = sums.agg(F.min("branch_length").alias("lo_"), F.max("branch_length").alias("hi_"))
    return sums.join(F.broadcast(ends)).select("node_id", "branch_length", ((F.col("branch_length") - F.col("lo_")) / F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0.0))).alias("scaled"))
