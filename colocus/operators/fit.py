"""Distances of gene pairs that share a term, and the mixture of an exponential and a uniform fitted to them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import circular_distance, exponential, log_spaced
from .pairs import salted

#: Numbers of distances by beginnings that a task fits at a time, besides those of one key.
CELLS = 100_000


def pair_distances(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Distances of pairs(organism_id, gene1, gene2) of genes with coordinates; gene1 <= gene2."""
    g = genes.select("organism_id", "gene_id", "gene_start", "gene_end", "size").distinct()
    a, b = g.toDF("organism_id", "gene1", "s1", "e1", "size"), g.drop("size").toDF("organism_id", "gene2", "s2", "e2")
    joined = pairs.join(a, ["organism_id", "gene1"]).join(b, ["organism_id", "gene2"])
    return joined.withColumn("distance", circular_distance(*map(F.col, ("s1", "e1", "s2", "e2", "size")), F.col("gene1") == F.col("gene2"))).drop("s1", "e1", "s2", "e2")


def all_pairs_histogram(genes: DataFrame) -> DataFrame:
    """Number of an organism's unordered pairs of annotated genes at each distance, genes with themselves too.

    Pairs are counted where they are made: a task sums them by distance, and only sums are shuffled.
    """
    g = genes.select("organism_id", "gene_id", "gene_start", "gene_end", "size").distinct()
    a, b = g.toDF("organism_id", "gene1", "s1", "e1", "size"), g.drop("size").toDF("organism_id", "gene2", "s2", "e2")
    met = salted(a, b, ["organism_id"]).where("gene1 <= gene2")
    return histogram(met.select("organism_id", circular_distance(*map(F.col, ("s1", "e1", "s2", "e2", "size")), F.col("gene1") == F.col("gene2")).alias("distance")))


def other_pairs_histogram(every: DataFrame, shared: DataFrame) -> DataFrame:
    """The histogram of every pair less that of the pairs that share a term: that of those which share none."""
    both = every.select("organism_id", "distance", "n").unionByName(shared.select("organism_id", "distance", (-F.col("n")).alias("n")))
    return both.groupBy("organism_id", "distance").agg(F.sum("n").alias("n")).where("n > 0")


def histogram(distances: DataFrame, key: str = "organism_id") -> DataFrame:
    """Number of pairs at each distance: all that the fit needs."""
    return distances.groupBy(key, "distance").agg(F.count("*").alias("n"))


def binned(distances: DataFrame, width: int = 900) -> DataFrame:
    """Counts and density of distances in bins."""
    counts = distances.groupBy(F.floor(F.col("distance") / width).alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("all_"))).select("bin", "n", (F.col("n") / (F.col("all_") * width)).alias("density"))


def fitted_density(params: DataFrame, points: int = 1000, key: str = "organism_id") -> DataFrame:
    """The fitted mixture's density at evenly spaced distances from 0 to half of each key's genome.

    params has rate, phi and half; keys whose rate is null, NaN or not positive are left out.
    """
    sound = params.where("rate > 0 and not isnan(rate)").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = sound.withColumn("distance", F.col("half") * F.col("point") / (points - 1))
    density = F.col("phi") * exponential(F.col("distance"), F.col("rate")) + (1 - F.col("phi")) / F.col("half")
    return at.select(key, "point", "distance", density.alias("density"))


def responsibilities(rows: DataFrame, rate, phi, key: str = "organism_id", half: str = "half") -> DataFrame:
    """zeta: the exponential's share at each distance; terms that underflow take the key's least other one.

    rate and phi are numbers, or columns of rows that hold each key's own.
    """
    phi = phi if isinstance(phi, Column) else F.lit(float(phi))
    e = phi * exponential(F.col("distance"), rate)
    filled = rows.withColumn("e_", e).withColumn("e_", F.when(F.col("e_") > 0, F.col("e_")).otherwise(F.min(F.when(F.col("e_") > 0, F.col("e_"))).over(Window.partitionBy(key))))
    return filled.withColumn("u_", (1 - phi) / F.col(half)).withColumn("zeta", F.col("e_") / (F.col("e_") + F.col("u_")))


def em_step(rows: DataFrame, rate: float, phi: float, key: str = "organism_id", n: str = "n") -> DataFrame:
    """One round of expectation-maximisation on a histogram (distance, n, half) of each key."""
    z = responsibilities(rows, rate, phi, key)
    weight = F.col(n) * F.col("zeta")
    return z.groupBy(key).agg(
        (F.sum(weight) / F.sum(weight * F.col("distance"))).alias("rate"), (F.sum(weight) / F.sum(n)).alias("phi"), F.sum(F.col(n) * F.ln(F.col("e_") + F.col("u_"))).alias("log_likelihood"), F.sum(n).alias("n_pairs")
    )


def em_run(rows: DataFrame, rate, phi, rounds: int = 1000, epsilon: float = 1e-8, key: str = "organism_id") -> DataFrame:
    """Expectation-maximisation on each key's histogram (distance, n, half) from one start until it settles.

    rate and phi are numbers, or columns of rows that are the same in all rows of a key. Returns key, rate,
    phi, log_likelihood and rounds, of which the last changed nothing where the likelihood settled: a fit then
    stands still, whatever the others of its table do. A key's histogram is one row, which holds its different
    distances, and all rounds are one expression over it, without a shuffle. An empty table gives an empty result.
    """
    start = [F.max(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for n, x in (("rate_", rate), ("phi_", phi))]
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("distance").cast("double").alias("x"), F.col("n").cast("double").alias("n")))).alias("h"), F.max("half").alias("half"), F.sum("n").cast("double").alias("all_"), *start)

    def total(values: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))

    def step(state: Column, _: Column) -> Column:
        q, p = state["rate"], state["phi"]
        raw = F.transform(F.col("h"), lambda v: F.struct(v["x"].alias("x"), v["n"].alias("n"), (p * q * F.exp(-q * v["x"])).alias("e")))
        least = F.coalesce(F.array_min(F.transform(F.filter(raw, lambda v: v["e"] > 0), lambda v: v["e"])), F.lit(1e-300))
        u = (1 - p) / F.col("half")
        filled = F.transform(F.array(F.struct(raw.alias("raw"), least.alias("least"), u.alias("u"))), lambda c: F.transform(c["raw"], lambda v: F.struct(v["x"].alias("x"), v["n"].alias("n"), F.when(v["e"] > 0, v["e"]).otherwise(c["least"]).alias("e"), c["u"].alias("u"))))[0]
        sums = F.transform(F.array(filled), lambda f: F.struct(
            total(f, lambda v: v["n"] * F.ln(v["e"] + v["u"])).alias("ll"), total(f, lambda v: v["n"] * v["e"] / (v["e"] + v["u"])).alias("mass"), total(f, lambda v: v["n"] * v["x"] * v["e"] / (v["e"] + v["u"])).alias("reach"),
        ))
        after = F.transform(sums, lambda s: _moved(state, s, epsilon))[0]
        return F.when(state["live"], after).otherwise(state)

    first = F.struct(F.col("rate_").alias("rate"), F.col("phi_").alias("phi"), F.lit(None).cast("double").alias("ll"), F.lit(0).alias("rounds"), F.lit(True).alias("live"))
    done = held.select(key, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("s"))
    return done.select(key, "s.rate", "s.phi", F.col("s.ll").alias("log_likelihood"), "s.rounds")


def _moved(state: Column, s: Column, epsilon: float) -> Column:
    """The state after a round with the sums s: parameters stay where the likelihood has settled."""
    settled = F.coalesce(F.abs(s["ll"] - state["ll"]) <= epsilon * F.greatest(F.abs(s["ll"]), F.abs(state["ll"])), F.lit(False))
    rate, phi = s["mass"] / F.greatest(s["reach"], F.lit(1e-300)), s["mass"] / F.col("all_")
    return F.struct(F.when(settled, state["rate"]).otherwise(rate).alias("rate"), F.when(settled, state["phi"]).otherwise(phi).alias("phi"), s["ll"].alias("ll"), (state["rounds"] + 1).alias("rounds"), (~settled).alias("live"))


def start_grid(mean: float, starts: int, phi_0: float, lambda_0: float | None) -> tuple[np.ndarray, np.ndarray]:
    """phi and rate of starts x starts beginnings: rates three powers of ten about that of lambda_0 or of 1 by the mean distance."""
    guess = lambda_0 if lambda_0 is not None else 1 / mean if mean > 0 else 1.0
    middle = int(np.log10(guess))
    grid = np.meshgrid(log_spaced(phi_0, 0.1, starts), log_spaced(10.0 ** (middle - 3), 10.0 ** (middle + 3), starts), indexing="ij")
    return grid[0].ravel().copy(), grid[1].ravel().copy()


def em_grids(x: np.ndarray, n: np.ndarray, half: np.ndarray, starts: int = 10, phi_0: float = 0.001, lambda_0: float | None = None, rounds: int = 1000, epsilon: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rate, phi and log likelihood of the best of starts x starts beginnings for each row of histograms; NaN where none stays a mixture.

    x and n have a row for each histogram, all of as many distances. Rounds go over all that has not settled of any row.
    """
    middles: dict[float, tuple[np.ndarray, np.ndarray]] = {}
    grids = []
    for mean in ((x * n).sum(axis=1) / n.sum(axis=1)).tolist():
        known = lambda_0 if lambda_0 is not None else int(np.log10(1 / mean if mean > 0 else 1.0))
        if known not in middles:
            middles[known] = start_grid(mean, starts, phi_0, lambda_0)
        grids.append(middles[known])
    phi, rate = (np.concatenate([g[k] for g in grids]) for k in (0, 1))
    of, live, best = np.repeat(np.arange(len(x)), starts * starts), np.arange(len(phi)), np.full(len(phi), np.nan)
    xs, ns, halves, every = x.T[:, of], n.T[:, of], half[of], n.sum(axis=1)[of]  # distances down, beginnings across
    for _ in range(rounds):
        if not len(live):
            break
        p, q = phi[live], rate[live]
        e = np.exp(-q * xs) * (p * q)
        if not e.all():
            least = np.where(e > 0, e, np.inf).min(axis=0)
            e = np.where(e > 0, e, np.where(np.isfinite(least), least, 1e-300))
        whole = e + (1 - p) / halves
        now = (np.log(whole) * ns).sum(axis=0)
        settled = np.abs(now - best[live]) <= epsilon * np.maximum(np.abs(now), np.abs(best[live]))  # not in the first round
        best[live] = now
        if settled.any():
            left = ~settled
            live, e, whole, xs, ns, halves, every = live[left], e[:, left], whole[:, left], xs[:, left], ns[:, left], halves[left], every[left]
        z = e / whole * ns
        mass = z.sum(axis=0)
        rate[live], phi[live] = mass / np.maximum((z * xs).sum(axis=0), 1e-300), mass / every
    best[(phi >= 1) | ~np.isfinite(best)] = -np.inf
    top = np.argmax(best.reshape(len(x), -1), axis=1) + np.arange(len(x)) * starts * starts
    return tuple(np.where(np.isfinite(best[top]), v[top], np.nan) for v in (rate, phi, best))


def em_grid(x: np.ndarray, n: np.ndarray, half: float, **how) -> tuple[float, float, float]:
    """em_grids of one histogram."""
    return tuple(float(v[0]) for v in em_grids(x[None].astype(float), n[None].astype(float), np.array([half]), **how))


def em_fit(rows: DataFrame, key: str = "organism_id", **how) -> DataFrame:
    """Fits the mixture to each key's histogram (distance, n, half).

    A key's histogram is one row; a task fits many keys with as many distances at a time, up to CELLS numbers.
    """
    kind = rows.schema[key].dataType.simpleString()
    pair = F.struct(F.col("distance").cast("double").alias("x"), F.col("n").cast("double").alias("n"))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(pair)).alias("h"), F.max("half").cast("double").alias("half")).select(key, "half", F.col("h.x").alias("x"), F.col("h.n").alias("n"))

    def fit(batches):
        for batch in batches:
            size = batch.column("x").value_lengths().to_numpy(zero_copy_only=False).astype(int)
            begin, half = np.cumsum(size) - size, batch.column("half").to_numpy(zero_copy_only=False)
            x, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "n"))
            out = np.full((3, len(size)), np.nan)
            order = np.argsort(size, kind="stable")
            for alike in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                width = size[alike[0]]
                step = max(1, CELLS // (width * how.get("starts", 10) ** 2))
                for some in (alike[k : k + step] for k in range(0, len(alike), step)):
                    at = begin[some][:, None] + np.arange(width)
                    out[:, some] = em_grids(x[at], n[at], half[some], **how)
            columns = [batch.column(key), batch.column("half"), *[pa.array(v) for v in out]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "half", "rate", "phi", "log_likelihood"])

    return held.mapInArrow(fit, f"{key} {kind}, half double, rate double, phi double, log_likelihood double")


def weighted_means(params: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted means of rate and phi over organisms; all weights count in the denominator."""
    rows = weights.select("organism_id", "weight").join(params.select("organism_id", "rate", "phi"), "organism_id", "left")
    w = F.col("weight")
    return rows.agg((F.sum(w * F.col("rate")) / F.sum(w)).alias("rate"), (F.sum(w * F.col("phi")) / F.sum(w)).alias("phi"))


def means(params: DataFrame) -> DataFrame:
    """Plain means of rate and phi over the organisms that have them."""
    return params.agg(F.avg("rate").alias("rate"), F.avg("phi").alias("phi"))


def agreement(rows: DataFrame, params: DataFrame, mean: DataFrame, key: str = "organism_id") -> DataFrame:
    """sensitivity() of each key's histogram under its own parameters and under the mean ones.

    params has a row (rate, phi) for each key, mean one row in all; keys without parameters are left out.
    """
    own = responsibilities(rows.join(params.select(key, "rate", "phi").where("rate > 0"), key), F.col("rate"), F.col("phi"), key)
    both = responsibilities(rows.join(F.broadcast(mean.select("rate", "phi"))), F.col("rate"), F.col("phi"), key)
    return sensitivity(own.select(key, "distance", "zeta"), both.select(key, "distance", "zeta"), [key, "distance"], key)


def sensitivity(own: DataFrame, mean: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Rates at which the mean parameters agree with a key's own, and the correlation of the two zetas."""
    both = own.select(*keys, F.col("zeta").alias("own")).join(mean.select(*keys, F.col("zeta").alias("mean")), keys)
    n_own, hit = F.count_if(F.expr("own > 0.5")), F.count_if(F.expr("mean > 0.5 and own > 0.5"))
    return both.groupBy(key).agg(
        n_own.alias("n_own"), (hit / F.nullif(n_own, F.lit(0))).alias("tpr"), (F.count_if(F.expr("mean > 0.5 and own <= 0.5")) / F.nullif(n_own, F.lit(0))).alias("fpr"), F.corr("own", "mean").alias("corr")
    )
