import inspect
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colocus.functions import scalar as h
from colocus.jobs import queries
from colocus.jobs.oracle import SQL
from colocus.jobs.queries import QUERIES
from colocus.operators import fit, hits, ontology, pairs, resample, subclades, tree
from colocus.sources import text

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "size", "same", "want"), [((100, 200), (300, 450), 1000, False, 351), ((10, 50), (900, 980), 1000, False, 151), ((100, 200), (100, 200), 1000, True, 101)])
def test_circular_distance(spark, a, b, size, same, want):
    assert one(spark, h.circular_distance(*map(F.lit, (*a, *b, size)), F.lit(same))) == want


def test_scalars(spark):
    assert one(spark, h.log_uniform(F.lit(50.0))) == pytest.approx(-46.0517018599)
    assert one(spark, h.log_uniform(F.lit(2e6))) == pytest.approx(-14.5086577385)
    for p, code in ((0.0, 0), (1.0, 1000), (0.5, 500), (0.9999, 999), (0.001, 1), (0.0009, -4), (1e-7, -7)):
        assert one(spark, h.probability_code(F.lit(p))) == code
    for (e, u), want in {(-8.0, -14.0): 0.9691526124, (-20.0, -14.0): 0.0001929995, (-800.0, -900.0): 1, (-900.0, -800.0): 0}.items():
        assert one(spark, h.posterior(F.lit(e), F.lit(u), 0.07225)) == pytest.approx(want, rel=1e-6)
    for n, bins, single in ((1, [1], 1), (7, [1, 5], 5), (10, [5, 10], 10), (49, [5, 10], 10), (50, [5, 10, 50], 50), (999, [50, 100, 500], 500)):
        assert sorted(one(spark, h.occurrence_bins(F.lit(n)))) == bins
        assert one(spark, h.single_bin(F.lit(n))) == single


def test_closest_pairs(spark):
    rows = [(1, 1, "a1", 100, 200), (1, 1, "a2", 500, 600), (1, 1, "f", 800, 900), (1, 2, "b1", 210, 300), (1, 2, "f", 800, 900)]
    genes = spark.createDataFrame([(*r, 10000) for r in rows], "organism_id int, domain_id int, gene_id string, gene_start int, gene_end int, size int")
    got = pairs.closest_pairs(pairs.gene_pair_distances(genes)).collect()
    assert sorted(r["distance"] for r in got) == [101, 201, 391]
    assert sum(r["fused"] for r in got) == 1


def near_by_hand(genes, size):
    """closest_pairs by loops over all partners: {(domain1, domain2): {(gene1, gene2): (distance, fused)}}."""

    def far(a, b):
        (s1, e1), (s2, e2) = (genes_at[x] for x in sorted((a, b)))
        if s1 > s2:
            s1, e1, s2, e2 = s2, e2, s1, e1
        return min(e2 - s1 + 1, size - s2 + e1 + 1)

    genes_at = {g: (s, e) for _, g, s, e in genes}
    of = {}
    for d, g, _, _ in genes:
        of.setdefault(d, set()).add(g)
    out = {}
    for d1 in of:
        for d2 in (x for x in of if x > d1):
            both = of[d1] & of[d2]
            a, b = of[d1] - both, of[d2] - both
            got = {(g, g): (genes_at[g][1] - genes_at[g][0] + 1, True) for g in both}
            if a and b:
                got |= {(g, p): (d, False) for g in a for d, p in [min((far(g, p), p) for p in b)]}
                got |= {(p, g): (d, False) for g in b for d, p in [min((far(g, p), p) for p in a)]}
            if got:
                out[d1, d2] = got
    return out


def test_nearest_pairs_by_loops(spark):
    """Random genes, nested, equal and around the end of the circle; against loops and against the whole product."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for organism in range(12):
        size = int(rng.integers(60, 4000))
        at = {g: (int(s), int(s + rng.integers(0, max(2, size // rng.integers(2, 30))))) for g, s in enumerate(rng.integers(0, size, 25))}
        genes = sorted({(int(d), int(g), *at[int(g)]) for d, g in zip(rng.integers(0, 6, 60), rng.integers(0, 25, 60), strict=True)})
        rows += [(organism, *r, size) for r in genes]
        want |= {(organism, *pair, *ids): v for pair, found in near_by_hand(genes, size).items() for ids, v in found.items()}
    genes = spark.createDataFrame(rows, "organism_id int, domain_id int, gene_id int, gene_start int, gene_end int, size int")
    for found in (pairs.nearest_pairs(genes), pairs.closest_pairs(pairs.gene_pair_distances(genes))):
        got = {tuple(r[c] for c in ("organism_id", "domain1", "domain2", "gene1", "gene2")): (r["distance"], r["fused"]) for r in found.collect()}
        assert got == want
    assert pairs.nearest_pairs(genes.limit(0)).isEmpty() and "gene2" not in pairs.nearest_pairs(genes)._jdf.queryExecution().analyzed().toString().split("Join")[-1]


def test_overlaps_by_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(o, g, int(s), int(s + n)) for o in range(3) for g, (s, n) in enumerate(zip(rng.integers(0, 3000, 60), rng.integers(0, 900, 60), strict=True))] + [(0, 99, None, 5), (0, 98, 50, 20)]
    want = {(o, g, h) for o, g, a, b in rows for p, h, c, d in rows if o == p and g < h and None not in (a, c) and g != 98 != h and min(b, d) - max(a, c) > 0}
    genes = spark.createDataFrame(rows, "organism_id int, gene_id int, gene_start int, gene_end int")
    for width in (7, 500, 100_000):
        assert {tuple(r) for r in pairs.overlapping_genes(genes, width).collect()} == want
    assert pairs.overlapping_genes(genes.limit(0)).isEmpty()


def test_clans_and_main(spark):
    rows = spark.createDataFrame([(1, "g", "D1", 1e-5, 1), (1, "g", "D2", 1e-5, 2), (1, "g", "D3", 1e-5, 3)], "organism_id int, gene_id string, domain_id string, evalue double, line_no int")
    clans = spark.createDataFrame([("D1", "A"), ("D2", "A")], "domain_id string, clan_id string")
    assert {r["domain_id"] for r in hits.resolve_clans(rows, clans).collect()} == {"D2", "D3"}
    molecules = spark.createDataFrame([(1, "m1", 10), (1, "m2", 30), (1, "m3", 30)], "organism_id int, molecule_id string, length long")
    assert hits.main_molecules(molecules).first()["molecule_id"] == "m2"


UNEVEN = "((p:6,q:2)r:4,s:0,((t:1,u:3,v:4)w:8,x:5)y:2);"


def test_tree_weights(spark):
    """By hand: r shares its 4 as 6 to 2; w its 8 as 1, 3 and 4; y its 2 among t 2, u 6, v 8 and x 5."""
    t = tree.numbered(text.newick_tree(spark, UNEVEN))
    scores = tree.closure_weights(tree.subclade_scores(t, 3))
    got = {r["organism_id"]: r for r in scores.where("subclade_id = 0").collect()}
    want = {"p": 9.0, "q": 3.0, "s": 0.0, "t": 2 * 23 / 21, "u": 6 * 23 / 21, "v": 8 * 23 / 21, "x": 5 * 23 / 21}
    assert {k: v["score"] for k, v in got.items()} == pytest.approx(want)
    assert {k: v["weight"] for k, v in got.items()} == pytest.approx({k: v / 9 * 6 / 7 + 1 / 7 for k, v in want.items()})
    assert got["p"]["mean_one"] == pytest.approx(9 * 7 / 35)
    d = {(r["organism1"], r["organism2"]): r["distance"] for r in tree.leaf_distances(t, 3).collect()}
    assert len(d) == 21 and d[("p", "q")] == 8 and d[("p", "s")] == 10 and d[("t", "x")] == 14 and d[("q", "v")] == 20


def test_tree_numbers_and_labels(spark):
    nodes = tree.numbered(text.newick_tree(spark, "((x:1,y:2)n:3,z:4);"))
    got = {r["organism_id"] or r["depth"]: (r["node_id"], r["parent_id"]) for r in nodes.collect()}
    assert got == {0: (0, None), 1: (4, 0), "z": (3, 0), "x": (2, 4), "y": (1, 4)}
    again = text.labelled_tree(spark, text.labelled_newick(nodes))
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.drop("bfs_idx").collect()))
    assert text.labelled_tree(spark, "(2__a:1,1__b:2);").where("parent_id is null").first()["node_id"] == 0


def caterpillar(n):
    """Inner nodes 0 to n - 2 in a chain, a leaf at each and two at the last; branches from the numbers, some of length 0."""
    rows = [(0, None, 0.0, None, False, 0)]
    for k in range(1, n - 1):
        rows.append((k, k - 1, 0.5 + k % 7, None, False, k))
    for k in range(n):
        up = min(k, n - 2)
        rows.append((n + k, up, float(k % 5), f"o{k}", True, up + 1))
    return rows


def test_deep_trees_by_loops(spark):
    """A caterpillar of 2,000 leaves: numbers, weights and lengths as a plain walk gives them, in a bounded number of jobs."""
    n = 2_000
    rows = caterpillar(n)
    t = tree.numbered(spark.createDataFrame(rows, "node_id long, parent_id long, dist double, organism_id string, is_leaf boolean, depth int"))
    new = {(r["organism_id"] or ("inner", r["depth"])): r for r in t.collect()}
    place = sorted(rows, key=lambda r: (r[5], not (r[0] < n), r[0]))  # in each level the inner node, whose number is smaller, comes first
    total = len(rows)
    assert all(new[r[3] or ("inner", r[5])]["node_id"] == (total - k if k else 0) for k, r in enumerate(place))
    height = n - 1
    score, sums = {}, {}
    for k in range(n - 2, -1, -1):  # from the lowest inner node up
        here = {n + j: (r[2] or tree.SMALLEST) for j, r in enumerate(rows[n - 1 :]) if r[1] == k}
        if k + 1 <= n - 2:
            d, whole = rows[k + 1][2], sums[k + 1]
            here |= {leaf: x + d * x / whole for leaf, x in score[k + 1].items()}
        score[k], sums[k] = here, sum(here.values())
    got = tree.subclade_scores(t, height)
    ids = {new[("inner", k)]["node_id"]: k for k in range(n - 1)}
    assert got.count() == sum(len(x) for x in score.values()) + n
    root = {r["organism_id"]: r["score"] for r in got.where("node_id = 0").collect()}
    assert root == pytest.approx({f"o{leaf - n}": x for leaf, x in score[0].items()}, rel=1e-9)
    some = [i for i, k in ids.items() if k % 400 == 7]
    for r in got.where(F.col("node_id").isin(some)).groupBy("node_id").agg(F.sum("score").alias("s"), F.count("*").alias("n")).collect():
        assert (r["s"], r["n"]) == (pytest.approx(sums[ids[r["node_id"]]], rel=1e-9), len(score[ids[r["node_id"]]]))
    length = {r["node_id"]: r["branch_length"] for r in tree.branch_sums(t, height).collect()}
    below = {n - 2: 0.0}
    for k in range(n - 2, -1, -1):
        below[k] = sum(r[2] for r in rows[n - 1 :] if r[1] == k) + (below[k + 1] + rows[k + 1][2] if k < n - 2 else 0.0)
    assert length == pytest.approx({i: below[k] for i, k in ids.items()})
    reach = sum(r[2] for r in rows[1 : n - 1])
    assert tree.diameter(t, height).first()[0] == pytest.approx(max(rows[n - 1][2] + reach + max(rows[-1][2], rows[-2][2]), max(rows[n - 1 + j][2] + sum(r[2] for r in rows[1 : min(j, n - 2) + 1]) for j in range(1, n)) + rows[n - 1][2]))


def test_roll_up_in_deep_trees(spark):
    """Plain and weighted sums of every node of a caterpillar, and their pruning, against the table of leaves in nodes."""
    n = 40
    t = tree.numbered(spark.createDataFrame(caterpillar(n), "node_id long, parent_id long, dist double, organism_id string, is_leaf boolean, depth int"))
    height = n - 1
    rng = np.random.default_rng(8)
    own = [(f"o{k}", a, b, -float(rng.random() * 9), int(rng.integers(1, 4)), 1, 2, 3) for k in range(n) for a in range(4) for b in range(a + 1, 4) if rng.random() < 0.3]
    own = spark.createDataFrame(own, "organism_id string, domain1 int, domain2 int, exp_prob double, occurrences long, fusions long, n_genes1 long, n_genes2 long")
    uniform = spark.createDataFrame([(f"o{k}", -5.0 - k / 7) for k in range(n)], "organism_id string, log_uni_prob double")
    closure = tree.closure_weights(tree.subclade_scores(t, height))
    columns = ["subclade_id", "domain1", "domain2", "occurrences", "fusions", "n_genes1", "n_genes2", "n_organisms", *[F.round(c, 6).alias(c) for c in ("log_exp", "log_uni", "prob")]]
    for weighted in (False, True):
        got = subclades.rolled_up(own, uniform, t, height, weighted=weighted)
        want = subclades.conserved_subclades(own, uniform, closure, weighted)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    flags = {(r["subclade_id"], r["domain1"], r["domain2"]): r["is_split"] for r in subclades.split_flags(got, t).collect()}
    rows = {(r["subclade_id"], r["domain1"], r["domain2"]): r["prob"] for r in got.collect()}
    up = {r["node_id"]: r["parent_id"] for r in t.collect()}
    want = {}
    for (node, a, b), p in rows.items():
        at = node
        while at is not None and (at, a, b) in flags and not flags[at, a, b]:
            at = up[at]
        if at is not None:
            want[node, a, b] = rows[at, a, b]
    assert {(r["subclade_id"], r["domain1"], r["domain2"]): r["prob"] for r in subclades.prune(got, t, height).collect()} == want


def test_roll_up_stores_leaves_once(spark, monkeypatch):
    """No round of the sums stores or shuffles the leaves' own rows again, weighted or not."""
    f = queries.Flow(spark, SF)
    leaves = {r[0] for r in f.tree.where("is_leaf").select("node_id").collect()}
    stored = []
    for module in (subclades, tree):
        monkeypatch.setattr(module, "staged", lambda df, name, of=module.staged: stored.append((name, out := of(df, name))) or out)
    for weighted in (False, True):
        stored.clear()
        subclades.rolled_up(f.organism, f.uniform, f.tree, 3, weighted=weighted)
        held = [name for name, df in stored if {"domain1", "node_id"} <= set(df.columns) and leaves & {r[0] for r in df.select("node_id").distinct().collect()}]
        assert held == ["leaf_pairs"]


def test_pairs_of_organisms_stay_in_place(spark, monkeypatch):
    """Rows of pairs are made where their organism's genes are; a large organism is dealt to several tasks, with the same result."""
    f = queries.Flow(spark, SF)
    plan = f.organism._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(organism_id" in plan and "hashpartitioning(organism_id#0L, domain" not in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "domain1" in x]
    want = sorted(tuple(r) for r in f.organism.select("organism_id", "domain1", "domain2", "occurrences", "fusions", "n_genes1", "n_genes2").collect())
    joined = queries.likelihood.organism_likelihoods(f.closest, f.counts)
    monkeypatch.setattr(pairs, "LARGE_ROWS", 1)
    dealt = queries.Flow(spark, SF).organism
    for other in (joined, dealt):
        assert sorted(tuple(r) for r in other.select("organism_id", "domain1", "domain2", "occurrences", "fusions", "n_genes1", "n_genes2").collect()) == want


def test_pruning_counts_without_a_join(spark):
    table = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (4, 1, 2), (5, 2, 3)], "subclade_id long, domain1 int, domain2 int")
    found = subclades.pruning_counts(table, table.where("subclade_id <> 5 and domain2 = 2"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 2, 1, 1), (4, 1, 1, 0), (5, 1, 0, 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_self_joins_of_large_keys(spark):
    kept = spark.range(300).selectExpr("id % 2 organism_id", "id domain_id", "id gene_id")
    a, b = kept.toDF("organism_id", "d1", "g1"), kept.toDF("organism_id", "d2", "g2")
    got, want = pairs.salted(a, b, ["organism_id"], rows=7), a.join(b, "organism_id")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()
    assert pairs.salted(a.limit(0), b.limit(0), ["organism_id"]).isEmpty()


def test_all_pairs_in_blocks(spark):
    """Every two rows of a key once, in order, whatever the blocks; a row goes to as many places as its key has blocks."""
    rows = spark.range(300).selectExpr("id % 2 k", "id * 7 % 300 organism_id", "id x")
    want = sorted((a % 2, a * 7 % 300, b * 7 % 300) for a in range(300) for b in range(300) if a % 2 == b % 2 and a * 7 % 300 < b * 7 % 300)
    for grain in (1, 6, 1_000):
        met = pairs.all_pairs(rows, ["k"], "organism_id", grain)
        assert sorted(tuple(r) for r in met.select("k", "one.organism_id", "two.organism_id").collect()) == want
    assert pairs.all_pairs(rows.limit(0), ["k"], "organism_id").isEmpty()


def test_leaf_distances_are_made_once(spark):
    """The largest distance comes from the tree, not from a second making of all pairs."""
    f = queries.Flow(spark, SF)
    made = [queries.leaf_distances(f, n)._jdf.queryExecution().optimizedPlan().toString().count("explode(sequence") for n in (True, False)]
    assert made[0] == made[1] > 0
    norm, plain = (sorted(tuple(r) for r in queries.leaf_distances(f, n).collect()) for n in (True, False))
    top = max(r[2] for r in plain)
    assert len(norm) == len(plain) == 149 * 148 // 2 and [r[2] for r in norm] == pytest.approx([r[2] / top * 0.9999 + 1e-4 for r in plain], abs=2e-6)


def test_empty_tables(spark):
    f = queries.Flow(spark, SF)
    kept, process = f.kept.limit(0), f.process
    genes = hits.gene_domains(kept)
    assert pairs.domain_pairs(kept).isEmpty() and pairs.closest_pairs(pairs.gene_pair_distances(genes)).isEmpty()
    assert ontology.go_pair_annotations(kept, process).isEmpty() and ontology.non_go_pairs(kept, process).isEmpty() and hits.gene_pool(kept).isEmpty()
    assert fit.em_fit(f.org_histogram.limit(0)).isEmpty() and resample.bin_counts(f.subclades.limit(0)).isEmpty()
    assert resample.bootstrap_means(spark.createDataFrame([], "organism_id long, rate double, phi double"), ["rate", "phi"], 10).isEmpty()
    assert tree.leaf_distances(f.tree.limit(0), 3).isEmpty() and subclades.prune(f.subclades.limit(0), f.tree, 3).isEmpty()


def test_observed_bins_by_a_plain_count(spark):
    rng = np.random.default_rng(3)
    p = [*rng.random(40).round(3).tolist(), 0.0004, 1.0]
    table = spark.createDataFrame([(7, 3, x) for x in p] + [(8, 12, 0.9)], "subclade_id long, occurrences long, prob double")
    got = {(r["subclade_id"], r["bin"]): r for r in resample.observed_bins(table).collect()}
    r, v = got[7, 1], np.sort([math.floor(x * 1000 + 1e-9) / 1000 for x in p])
    assert (r["n"], r["e_4"], r["e_3"]) == (42, v[-1], v[-10]) and r["pct_above"] == ((v > 0.5).sum() + 1) / 43
    assert (r["mean"], r["median"], r["statistic"]) == pytest.approx((v.mean(), np.median(v), v[v > 0.5].sum() * 1000 / 42))
    assert set(got) == {(7, 1), (8, 10), (8, 5)} and got[8, 5]["e_3"] is None
    assert resample.observed_bins(table.limit(0)).isEmpty()


def test_histogram_of_values(spark):
    values = spark.createDataFrame([("x", 0.0), ("x", 1.0), ("x", 4.0), ("x", None), ("y", 2.0), ("y", 2.0)], "parameter string, mean double")
    got = sorted(tuple(r) for r in resample.histogram_of(values, 4).collect())
    assert got == [("x", 0, 0.0, 1, 1 / 3), ("x", 1, 1.0, 1, 1 / 3), ("x", 3, 3.0, 1, 1 / 3), ("y", 0, 2.0, 2, None)]
    assert resample.histogram_of(values.limit(0)).isEmpty()
    params = spark.createDataFrame([("a", 0.01, 0.3, 500.0), ("b", float("nan"), 0.1, 500.0), ("c", None, None, 9.0)], "organism_id string, rate double, phi double, half double")
    d = sorted((r["distance"], r["density"]) for r in fit.fitted_density(params, 1001).collect())
    assert len(d) == 1001 and d[-1][0] == 500 and sum(y for _, y in d) * 0.5 == pytest.approx(0.7 + 0.3 * (1 - math.exp(-5)), rel=0.01)


def test_bootstrap_of_means(spark):
    """Mean and spread against theory; weights that are all alike change nothing."""
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, 400)
    params = spark.createDataFrame([(f"o{k}", float(v), 2.0) for k, v in enumerate(x)] + [("none", None, 2.0)], "organism_id string, rate double, w double")
    plain, weighted = (resample.bootstrap_summary(resample.bootstrap_means(params, ["rate"], 20_000, weight=w)).first() for w in (None, "w"))
    assert plain["mean"] == pytest.approx(x.mean(), abs=0.01) and plain["sd"] == pytest.approx(x.std() / 20, rel=0.05)
    assert weighted["sd"] == pytest.approx(plain["sd"], rel=1e-6) and plain["p97_5"] - plain["p2_5"] == pytest.approx(4 * plain["sd"], rel=0.05)


def test_resample_counts_by_a_plain_loop(spark):
    """Every sample's mean from counts that a loop draws with the same numbers; any deal of the rows gives the same."""
    x, w = [1.0, 4.0, 9.0, 2.5], [1.0, 0.5, 2.0, 1.0]
    params = spark.createDataFrame(list(zip([3, 8, 10**9, 4], x, w, strict=True)), "organism_id long, rate double, w double")
    want = {}
    for sample in range(50):
        counts = []
        for key in (3, 8, 10**9, 4):
            u, below, k = h.mixed(8290, sample, key) / h.MODULUS, math.exp(-1), 0
            while u >= below:
                k += 1
                below += math.exp(-1) / math.factorial(k)
            counts.append(k)
        if any(counts):
            want[sample] = sum(c * a * b for c, a, b in zip(counts, x, w, strict=True)) / sum(c * b for c, b in zip(counts, w, strict=True))
    for how in ({}, {"chunk": 7, "slice_rows": 1}):
        got = resample.bootstrap_means(params, ["rate"], 50, weight="w", **how).where("mean is not null").collect()
        assert {r["sample"]: r["mean"] for r in got} == pytest.approx(want)


def test_counts_of_many_rows_and_samples(spark, monkeypatch):
    """Counts of arrays are those of columns, at the edges too; means do not depend on blocks, and rows are not repeated for every sample."""
    keys = np.array([0, 1, 7, 12345, h.MODULUS - 1, h.MODULUS, (1 << 31) - 1, *range(1000, 5000, 7)])
    got = h.poisson_counts(8290, np.arange(200), keys)
    assert (got == np.searchsorted(h.poisson_limits(), h.mixed(8290, np.arange(200)[:, None], keys), "right")).all()
    assert [int(x) for x in got[3, :20]] == [r[0] for r in spark.createDataFrame([(k, int(x)) for k, x in enumerate(keys[:20])], "k int, x long").orderBy("k").select(h.poisson_count(h.mixed(8290, F.lit(3), F.col("x")))).collect()]
    params = spark.createDataFrame([(k, float(k % 13), 1.0 + k % 3) for k in range(500)], "organism_id long, rate double, w double")
    found = resample.bootstrap_means(params, ["rate"], 90, weight="w")
    one = {r["sample"]: r["mean"] for r in found.collect()}
    monkeypatch.setattr(resample, "BLOCK", (3, 11))
    assert one == pytest.approx({r["sample"]: r["mean"] for r in resample.bootstrap_means(params, ["rate"], 90, weight="w", chunk=40, slice_rows=100).collect()})
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_numbers(spark):
    """Evenness of single numbers and of neighbours, and the same from columns as from arrays."""
    a = h.mixed(8290, 0, 500, np.arange(2000)[:, None], np.arange(500))
    tenth = a * 10 // h.MODULUS
    for x, y in ((tenth[:, :-1], tenth[:, 1:]), (tenth[:-1], tenth[1:]), (tenth[:, :-8], tenth[:, 8:])):
        seen = np.histogram2d(x.ravel(), y.ravel(), 10)[0]
        assert ((seen - seen.mean()) ** 2 / seen.mean()).sum() < 160  # 99 degrees of freedom
    got = [r[0] for r in spark.range(50).select(h.mixed(8290, F.lit(0), F.lit(500), F.lit(7), F.col("id"))).collect()]
    assert sorted(got) == sorted(a[7, :50].tolist())
    counts = np.array([r[0] for r in spark.range(20_000).select(h.poisson_count(h.mixed(1, F.col("id")))).collect()])
    assert abs(counts.mean() - 1) < 0.03 and abs(counts.var() - 1) < 0.05


def test_bin_bootstrap_by_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    p = rng.random(160).round(3)
    table = spark.createDataFrame([(4, 1, float(x)) for x in p] + [(5, 3, 0.9)] * 20, "subclade_id long, occurrences long, prob double")
    for fraction in (False, True):
        got = {(r["subclade_id"], r["bin"]): r for r in resample.bin_bootstrap(table, 500, fraction=fraction).collect()}
        codes = sorted(int(x * 1000) if x >= 0.001 else 0 for x in p.tolist())
        kinds = sorted(set(codes))
        draw = np.random.default_rng([resample.SEED, 4, 1])
        values = []
        for _ in range(500):
            k = draw.multinomial(160, [codes.count(c) / 160 for c in kinds])
            values.append(sum((1.0 if fraction else c) * n for c, n in zip(kinds, k.tolist(), strict=True) if c > 500) / 160)
        values.sort()
        r = got[4, 1]
        assert (r["n_pairs"], r["e_4"], r["e_3"]) == (160, pytest.approx(values[-1]), pytest.approx(values[-10]))
        assert (r["mean"], r["median"], r["pct_above"]) == pytest.approx((sum(values) / 500, (values[249] + values[250]) / 2, (sum(v > 0.5 for v in values) + 1) / 501))
        assert r["mean"] == pytest.approx(sum((1.0 if fraction else c) for c in codes if c > 500) / 160, rel=0.05)
        assert got[5, 1]["n_pairs"] == 20 and got[5, 1]["mean"] is None and got[5, 1]["e_3"] is None
    assert resample.bin_bootstrap(table.limit(0)).isEmpty()


def test_bins_of_few_pairs_are_not_resampled_in_groups(spark):
    table = spark.createDataFrame([(k, 1, 0.9) for k in range(5)] + [(9, 1, 0.7)] * 120, "subclade_id long, occurrences long, prob double")
    found = resample.bin_bootstrap(table, 20)
    assert sorted((r["subclade_id"], r["n_pairs"], r["mean"]) for r in found.collect()) == [*((k, 1, None) for k in range(5)), (9, 120, 700.0)]
    grouped = found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[1]
    assert ">= 100" in grouped


def test_fit_of_organisms_by_a_plain_loop(spark):
    rows = spark.createDataFrame([(o, d, n, 5000.0) for o, some in {"a": [(10, 3), (200, 2), (4000, 5)], "b": [(50, 4), (900, 1), (2500, 6)]}.items() for d, n in some], "organism_id string, distance long, n long, half double")
    for r in fit.em_fit(rows, starts=3).collect():
        x = np.repeat(*np.array([(q["distance"], q["n"]) for q in rows.where(F.col("organism_id") == r["organism_id"]).collect()]).T).astype(float)
        best = None
        middle = int(np.log10(1 / x.mean()))
        for phi in h.log_spaced(0.001, 0.1, 3):
            for rate in h.log_spaced(10.0 ** (middle - 3), 10.0 ** (middle + 3), 3):
                p, q, last = phi, rate, None
                for _ in range(1000):
                    e = p * q * np.exp(-q * x)
                    e = np.where(e > 0, e, e[e > 0].min() if (e > 0).any() else 1e-300)
                    ll = np.log(e + (1 - p) / 5000).sum()
                    if last is not None and math.isclose(ll, last, rel_tol=1e-8):
                        break
                    last = ll
                    z = e / (e + (1 - p) / 5000)
                    q, p = z.sum() / (z @ x), z.mean()
                if p < 1 and (best is None or ll > best[0]):
                    best = (ll, q, p)
        assert (r["log_likelihood"], r["rate"], r["phi"]) == pytest.approx(best, rel=1e-5)


def test_fits_of_many_organisms_at_a_time(spark, monkeypatch):
    """Every organism's fit is that of its histogram alone, however many are fitted at a time, and no group goes to Python on its own."""
    rng = np.random.default_rng(4)
    some = {o: sorted(zip(rng.choice(9000, 1 + o % 7, replace=False).tolist(), rng.integers(1, 6, 1 + o % 7).tolist(), strict=True)) for o in range(60)}
    some |= {60: [(3, 1), (10**8, 2)], 61: [(0, 2)]}
    rows = spark.createDataFrame([(o, d, n, 5000.0 + o) for o, x in some.items() for d, n in x], "organism_id long, distance long, n long, half double")
    want = {o: fit.em_grid(*(np.array(v, float) for v in zip(*x, strict=True)), 5000.0 + o, starts=3) for o, x in some.items()}
    for cells in (1, 100_000):
        monkeypatch.setattr(fit, "CELLS", cells)
        found = fit.em_fit(rows, starts=3)
        got = {r["organism_id"]: (r["rate"], r["phi"], r["log_likelihood"]) for r in found.collect()}
        assert set(got) == set(want) and all(got[o] == pytest.approx(want[o], rel=1e-9, nan_ok=True) for o in want)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fit_by_expressions(spark):
    """Whole fits from single starts in one expression: their best is that of the grid; a given rate sets the grid's middle."""
    rows = spark.createDataFrame([(o, d, n, 5000.0) for o, some in {"a": [(10, 30), (200, 20), (4000, 50)], "b": [(50, 4), (900, 1), (2500, 6)]}.items() for d, n in some], "organism_id string, distance long, n long, half double")
    for how in ({}, {"lambda_0": 0.05}):
        grid = {r["organism_id"]: r for r in fit.em_fit(rows, starts=3, **how).collect()}
        for organism, mean in (("a", 2043.0), ("b", 16100 / 11)):
            phis, rates = fit.start_grid(mean, 3, 0.001, how.get("lambda_0"))
            assert max(rates) == pytest.approx(1e2 if how else 1.0)
            starts = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(zip(phis, rates, strict=True))], "start int, p double, q double")
            own = rows.where(F.col("organism_id") == organism).crossJoin(starts)
            found = [r for r in fit.em_run(own, F.col("q"), F.col("p"), key="start").collect() if r["phi"] < 1]
            best = max(found, key=lambda r: r["log_likelihood"])
            assert (best["rate"], best["phi"], best["log_likelihood"]) == pytest.approx((grid[organism]["rate"], grid[organism]["phi"], grid[organism]["log_likelihood"]), rel=1e-5)
            assert max(r["rounds"] for r in found) > 3
    assert fit.em_run(rows.limit(0), 0.001, 0.1).isEmpty()


def test_permutations_use_tree_distances(spark):
    t = text.newick_tree(spark, "((K:12,(A:0,B:0)low:9)mid:7,D:40);")
    d = {(r["organism1"], r["organism2"]): r["norm_distance"] for r in tree.pair_distances(spark.createDataFrame([("A", "B"), ("D", "A"), ("D", "K")], "organism1 string, organism2 string"), t, 3).collect()}
    assert d == pytest.approx({("A", "B"): 1e-4, ("D", "A"): 56 / 59 * 0.9999 + 1e-4, ("D", "K"): 1.0})
    bins = spark.createDataFrame([(0, 2)], "subclade_id int, bin long")
    uniform = spark.createDataFrame([("A", -9.0), ("B", -9.0), ("D", -9.0)], "organism_id string, log_uni_prob double")
    pool = spark.createDataFrame([(o, i, i * 100, i * 100 + 9, 1000) for o in "ABD" for i in range(9)], "organism_id string, gene_idx long, gene_start int, gene_end int, size int")

    def moved(*members, weights=None):
        of = spark.createDataFrame([(0, m) for m in members], "subclade_id int, organism_id string")
        return resample.permutations(bins, of, pool, uniform, lambda x: tree.pair_distances(x, t, 3), n_perm=200, weights=weights)

    near, far = (moved("A", x).agg(F.avg("moved")).first()[0] for x in "BD")
    # half of the time both draws are one organism's, and the second moves with 1 - 1/2; else the other's moves with its distance
    assert near == pytest.approx(0.125, abs=0.06) and far == pytest.approx(0.125 + 0.25 * (56 / 59), abs=0.06)
    half = spark.createDataFrame([(0, "A", 0.5), (0, "B", 0.5)], "subclade_id int, organism_id string, weight double")
    assert moved("A", "B", weights=half).select("log_uni").distinct().collect() == [(-9.0,)]
    assert resample.summary(moved("A", "B"), ["bin"]).first()["moved"] == pytest.approx(near)


def test_permutations_by_a_plain_loop(spark, monkeypatch):
    """Draw by draw with the same numbers, for many small bins and a large one, however rows fall into batches; no call a bin or an organism."""
    genes = {o: [(100 * i + 7 * o, 100 * i + 40 + 9 * ((i + o) % 5)) for i in range(1 + 3 * o)] for o in range(6)}
    of = {0: [0, 1, 2, 3, 4, 5], 7: [1, 4], 9: [2], 11: [5]}
    bins = [(s, b) for s in of for b in (1, 5, 50)]
    norm = lambda a, b: (abs(a - b) + 1) / 8
    want = {}
    for s, b in bins:
        for perm in range(3):
            counts = {}
            for j in range(b):
                at = h.mixed(8290, s, b, perm, j) * len(of[s]) // h.MODULUS
                counts[at] = counts.get(at, 0) + 1
            first = min(counts, key=lambda at: (h.mixed(8291, s, b, perm, at), at))
            log_exp = moves = 0
            for at, m in counts.items():
                o, key = of[s][at], h.mixed(8292, s, b, perm, at)
                stays = 1 / m if at == first else (1 - norm(o, of[s][first])) / m
                for k in range(m):
                    draw = int(h.mixed(np.int64(key), k))
                    moved = draw / h.MODULUS >= stays and not (at == first and k == 0)
                    (i1, a), (i2, c) = ((i, genes[o][i]) for i in (h.mixed(draw, x) * len(genes[o]) // h.MODULUS for x in (1, 2)))
                    low, high = (a, c) if a[0] <= c[0] else (c, a)
                    far = a[1] - a[0] + 1 if i1 == i2 else min(high[1] - low[0] + 1, 2000 - high[0] + low[1] + 1)
                    log_exp += math.log(resample.LAMBDA) - resample.LAMBDA * (far if moved else a[1] - a[0] + c[1] - c[0] + 2)
                    moves += moved
            want[s, b, perm] = (log_exp, moves / b)
    members = spark.createDataFrame([(s, o) for s, x in of.items() for o in x], "subclade_id long, organism_id long")
    pool = spark.createDataFrame([(o, i, *g, 2000) for o, x in genes.items() for i, g in enumerate(x)], "organism_id long, gene_idx long, gene_start long, gene_end long, size long")
    uniform = spark.createDataFrame([(o, -9.0) for o in genes], "organism_id long, log_uni_prob double")
    apart = spark.createDataFrame([(a, b, norm(a, b)) for a in genes for b in genes], "organism1 long, organism2 long, norm_distance double")
    made = spark.createDataFrame(bins, "subclade_id long, bin long")
    for batch, draws in ((10_000, 500_000), (3, 20)):
        monkeypatch.setattr(resample, "DRAWS", draws)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = resample.permutations(made, members, pool, uniform, lambda x: x.distinct().join(apart, ["organism1", "organism2"]), n_perm=3)
            got = {(r["subclade_id"], r["bin"], r["perm"]): (r["log_exp"], r["moved"]) for r in found.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "CoGroup" not in plan


def test_resampling_covers_all_bins_and_subclades(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(resample, "permutations", lambda bins, *a, **k: asked.update(bins=bins, options=k))
    queries.permutation_draws(f := queries.Flow(spark, SF))
    pairs_of = f.subclades.where("occurrences > 0").select("subclade_id").distinct()
    assert asked["bins"].select("subclade_id").distinct().count() == pairs_of.count() and "n_perm" not in asked["options"]
    assert asked["bins"].agg(F.max("bin")).first()[0] == resample.bin_counts(f.subclades).agg(F.max("bin")).first()[0]
    defaults = inspect.signature(resample.bin_bootstrap).parameters["samples"].default
    assert defaults == 10_000 and f.subclades.join(f.tree.where("depth >= 2").select(F.col("node_id").alias("subclade_id")), "subclade_id").join(asked["bins"], "subclade_id").count()


def test_em_recovers_a_mixture():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(1000, 3000), rng.uniform(0, 50000, 27000)]).round()
    values, n = np.unique(x, return_counts=True)
    rate, phi, _ = fit.em_grid(values, n, 50000.0)
    assert rate == pytest.approx(1e-3, rel=0.2) and phi == pytest.approx(0.1, rel=0.2)
    assert fit.em_grid(x, np.ones(len(x)), 50000.0, starts=3)[:2] == pytest.approx(fit.em_grid(values, n, 50000.0, starts=3)[:2], rel=1e-6)
    with pytest.raises(ValueError):
        h.log_spaced(0, 1, 3)
    assert math.isclose(h.log_spaced(1, 100, 3)[1], 10)


def test_text_sources(spark):
    lines = spark.createDataFrame([("# c", "o"), ("Dom_a  PF00001.12  gene_1  -  1e-9  30.1  0.0  1e-5", "o")], "value string, organism_id string")
    assert tuple(text.domain_hits(lines).first()) == ("o", "gene_1", "00001", 1e-5)
    lines = spark.createDataFrame([("!c",), ("Pfam:PF00001 Dom_a > GO:some process ; GO:0000001",)], "value string")
    assert tuple(text.domain_terms(lines).first()) == ("GO:0000001", "00001")
    stanza = spark.createDataFrame([('[Term]\nid: GO:0000001\nname: some process\nnamespace: biological_process\ndef: "text"',)], "value string")
    assert tuple(text.ontology_terms(stanza).first()) == ("GO:0000001", "some process", "biological_process", '"text"')


@pytest.mark.parametrize("name", ["conserved_root", "closest_pairs", "go_pair_annotations", "gsc_weights", "pruned_subclades", "pair_split", "sensitivity_rates", "leaf_distances", "bin_pairs", "observed_bins", "param_histogram", "fitted_density", "conserved_subclades_weighted", "non_go_distance_histogram", "param_resamples_weighted", "permutation_probs_weighted", "em_rounds"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted((tuple(None if v != v else v for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=lambda r: [(v is None, v) for v in r])
    assert rows(got) == rows(want)
