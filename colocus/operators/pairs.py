"""Pairs of domains and of genes within a genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import circular_distance, overlaps

PAIR = ["organism_id", "domain1", "domain2"]
#: Rows of a key's one side that a task of a self-join takes; a key with more is dealt to several.
SALT_ROWS = 2_000
#: Rows of an organism up to which its genes and domains meet in one task.
LARGE_ROWS = 20_000
#: all_pairs deals a key's rows to as many blocks as the root of their number by this.
GRAIN = 250


def salted(one: DataFrame, other: DataFrame, keys: list[str], rows: int = SALT_ROWS) -> DataFrame:
    """Joins two views of the same rows on keys, with the first view of a large key dealt to several tasks.

    The number of parts of a key is its rows in the first view by `rows`; the second view is repeated for
    each. Keys of few rows, which are most, have one part.
    """
    parts = one.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("parts_"))
    dealt = one.join(parts, keys).withColumn("part_", F.pmod(F.xxhash64(*[c for c in one.columns if c not in keys]), F.col("parts_"))).drop("parts_")
    spread = other.join(parts, keys).withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_") - 1))).drop("parts_")
    return dealt.join(spread, [*keys, "part_"]).drop("part_")


def all_pairs(rows: DataFrame, keys: list[str], order: str, grain: int = GRAIN) -> DataFrame:
    """Every two rows of a key once, as the structs one and two, of which one is the smaller by `order`.

    A key's rows are dealt to blocks, and every two blocks meet in one place, to which each row goes once a block. The
    number of blocks grows with the root of the rows, so that the shuffle grows with their power of 1.5 while only the
    pairs themselves grow with the square. `order` has no equals in a key.
    """
    parts = rows.groupBy(*keys).agg(F.ceil(F.sqrt(F.count("*") / grain)).alias("parts_"))
    at = F.pmod(F.xxhash64(order), F.col("parts_"))
    dealt = rows.join(parts, keys).select(*keys, at.alias("at_"), "parts_", F.struct(*[c for c in rows.columns if c not in keys]).alias("row_"))
    low = dealt.select(*keys, F.col("at_").alias("low_"), F.explode(F.sequence("at_", F.col("parts_") - 1)).alias("high_"), F.col("row_").alias("one"))
    high = dealt.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "at_")).alias("low_"), F.col("at_").alias("high_"), F.col("row_").alias("two"))
    ahead = F.col(f"one.{order}") < F.col(f"two.{order}")
    met = low.join(high, [*keys, "low_", "high_"]).where((F.col("low_") < F.col("high_")) | ahead)
    return met.select(*keys, F.when(ahead, F.col("one")).otherwise(F.col("two")).alias("one"), F.when(ahead, F.col("two")).otherwise(F.col("one")).alias("two"))


def domain_pairs(kept: DataFrame) -> DataFrame:
    """All unordered pairs of an organism's domains."""
    d = kept.select("organism_id", "domain_id").distinct()
    a, b = d.withColumnRenamed("domain_id", "domain1"), d.withColumnRenamed("domain_id", "domain2")
    return salted(a, b, ["organism_id"]).where("domain1 < domain2")


def genes_in_either(counts: DataFrame, distances: DataFrame) -> DataFrame:
    """Per pair of domains with genes: distinct genes that hold either, those that hold both counted once."""
    one, two = counts.toDF("organism_id", "domain1", "n_genes1"), counts.toDF("organism_id", "domain2", "n_genes2")
    shared = distances.groupBy(*PAIR).agg(F.count_if("fused").alias("both"))
    return shared.join(one, ["organism_id", "domain1"]).join(two, ["organism_id", "domain2"]).select(*PAIR, (F.col("n_genes1") + F.col("n_genes2") - F.col("both")).alias("n_genes"))


def gene_pair_distances(genes: DataFrame) -> DataFrame:
    """Every gene of the one domain with every gene of the other, for every pair of domains."""
    a = genes.toDF("organism_id", "domain1", "gene1", "start1", "end1", "size")
    b = genes.drop("size").toDF("organism_id", "domain2", "gene2", "start2", "end2")
    joined = salted(a, b, ["organism_id"]).where("domain1 < domain2")
    swap = F.col("gene1") > F.col("gene2")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in (("start1", "start2"), ("end1", "end2"), ("start2", "start1"), ("end2", "end1"))]
    same = F.col("gene1") == F.col("gene2")
    return joined.select(*PAIR, "gene1", "gene2", circular_distance(*ends, F.col("size"), same).alias("distance"), same.alias("fused"))


def overlapping_genes(genes: DataFrame, width: int = 5_000) -> DataFrame:
    """Pairs of an organism's annotated genes that overlap, by the bins of positions that they touch.

    Two genes that overlap share the bin in which the later one begins, and meet there only. Genes with a null
    coordinate overlap nothing; a gene whose end is before its start touches no bin.
    """
    g = genes.select("organism_id", "gene_id", "gene_start", "gene_end").where("gene_start <= gene_end").distinct()
    first, last = (F.floor(F.col(c) / width) for c in ("gene_start", "gene_end"))
    g = g.select("*", first.alias("first"), F.explode(F.sequence(first, last)).alias("bin"))
    a, b = g.toDF("organism_id", "gene1", "start1", "end1", "first1", "bin"), g.toDF("organism_id", "gene2", "start2", "end2", "first2", "bin")
    met = a.join(b, ["organism_id", "bin"]).where("gene1 < gene2 and bin = greatest(first1, first2)")
    return met.where(overlaps(*map(F.col, ("start1", "end1", "start2", "end2")))).select("organism_id", "gene1", "gene2")


def fusions(distances: DataFrame) -> DataFrame:
    return distances.where("fused").groupBy(*PAIR).agg(F.count("*").alias("fusions"))


def closest_pairs(distances: DataFrame) -> DataFrame:
    """Fused genes, and of the other genes on either side each one's nearest partner, every pair once."""
    first, second = Window.partitionBy(*PAIR, "gene1"), Window.partitionBy(*PAIR, "gene2")
    marked = distances.withColumn("f1", F.max("fused").over(first)).withColumn("f2", F.max("fused").over(second))
    left = marked.where("fused or (not f1 and not f2)")
    ranked = left.withColumn("r1", F.row_number().over(first.orderBy("distance", "gene2"))).withColumn("r2", F.row_number().over(second.orderBy("distance", "gene1")))
    return ranked.where("fused or r1 = 1 or r2 = 1").select(*PAIR, "gene1", "gene2", "distance", "fused")


def nearest_pairs(genes: DataFrame, counted: bool = False) -> DataFrame:
    """closest_pairs of all pairs of domains without the product of their genes.

    The genes of both domains stand in one order of position, and each takes its nearest partner from four
    that the order gives: of the partners before it the one that starts last or, around the circle, ends first,
    and of those after it the one that ends first or, around the circle, starts last. Equal distances go to the
    smaller id. Genes of both domains are fused; they count once and are no partners. A row a gene and
    other domain of its organism, which is not shuffled unless an organism is large; an empty table gives an empty
    result. With counted each pair has the number of either domain's genes, n_genes1 and n_genes2.
    """
    local = genes.groupBy("organism_id").count().where(F.col("count") > LARGE_ROWS).isEmpty()
    domains = genes.groupBy("organism_id", F.col("domain_id").alias("other")).agg(F.count_distinct("gene_id").alias("n_other"))
    own = F.size(F.collect_set("gene_id").over(Window.partitionBy("organism_id", "domain_id"))).cast("long")
    g = genes.withColumn("held", F.collect_set("domain_id").over(Window.partitionBy("organism_id", "gene_id"))).withColumn("n_own", own)
    one, other = F.least("domain_id", "other"), F.greatest("domain_id", "other")
    met = g.join(domains, "organism_id") if local else salted(g, domains, ["organism_id"])
    rows = met.where("domain_id <> other").select(
        "organism_id", one.alias("domain1"), other.alias("domain2"), (F.col("domain_id") < F.col("other")).alias("one"), F.array_contains("held", F.col("other")).alias("fused"),
        "gene_id", F.col("gene_start").alias("s"), F.col("gene_end").alias("e"), "size", "n_own", "n_other",
    )
    up = Window.partitionBy(*PAIR).orderBy("s", "gene_id").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*PAIR).orderBy(F.desc("s"), F.desc("gene_id")).rowsBetween(Window.unboundedPreceding, -1)
    ends, starts = F.struct("e", "gene_id"), F.struct((-F.col("s")).alias("s"), "gene_id")

    def partner(value: Column, over: WindowSpec) -> Column:
        """The least value among the other domain's genes in a frame."""
        return F.when(F.col("one"), F.min(F.when(~F.col("one") & ~F.col("fused"), value)).over(over)).otherwise(F.min(F.when(F.col("one") & ~F.col("fused"), value)).over(over))

    seen = rows.select("*", partner(starts, up).alias("a"), partner(ends, up).alias("b")).select("*", partner(ends, down).alias("c"), partner(starts, down).alias("d"))
    reach = {"a": "e + a.s + 1", "b": "size - s + b.e + 1", "c": "c.e - s + 1", "d": "size + d.s + e + 1"}
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.expr(d).alias("distance"), F.col(f"{k}.gene_id").alias("partner"))) for k, d in reach.items()])))
    near = seen.withColumn("best", best).where("(fused and one) or (not fused and best is not null)")
    mate = F.when(F.col("fused"), F.col("gene_id")).otherwise(F.col("best.partner"))
    ids = [F.when(F.col("one"), x).otherwise(y).alias(n) for n, x, y in (("gene1", F.col("gene_id"), mate), ("gene2", mate, F.col("gene_id")))]
    n_genes = [F.when(F.col("one"), F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("n_genes1", "n_own", "n_other"), ("n_genes2", "n_other", "n_own"))]
    near = near.select(*PAIR, *ids, F.when(F.col("fused"), F.col("e") - F.col("s") + 1).otherwise(F.col("best.distance")).alias("distance"), "fused", F.when(F.col("fused"), F.struct("s", "e")).alias("at_"), *n_genes)
    chosen = near.groupBy(*PAIR, "gene1", "gene2", "fused", "at_").agg(F.min("distance").alias("distance"), *[F.max(n).alias(n) for n in ("n_genes1", "n_genes2")])
    return chosen.select(*PAIR, "gene1", "gene2", "distance", "fused", *(["n_genes1", "n_genes2"] if counted else []))


def dense_index(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers rows from 0 in the order of group, then order, without sorting all rows in one task.

    Only the table of groups with their counts is put in one order.
    """
    counts = rows.groupBy(*group).agg(F.count("*").alias("k_"))
    before = counts.select(*group, F.coalesce(F.sum("k_").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inside = rows.withColumn("at_", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return inside.join(before, group).withColumn(name, (F.col("before_") + F.col("at_") - 1).cast("long")).drop("before_", "at_")


def pair_index(pairs: DataFrame) -> DataFrame:
    """A dense number for every pair of domains in any organism, in their order."""
    return dense_index(pairs.select("domain1", "domain2").distinct(), ["domain1"], ["domain2"], "pair_id")


def gene_pairs(genes: DataFrame) -> DataFrame:
    """All unordered pairs of an organism's annotated genes, each with itself too."""
    g = genes.select("organism_id", "gene_id").distinct()
    return salted(g.withColumnRenamed("gene_id", "gene1"), g.withColumnRenamed("gene_id", "gene2"), ["organism_id"]).where("gene1 <= gene2")
