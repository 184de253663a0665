"""Embedding near-duplicates by dual traversal of cover trees, exact at the threshold.

The upper levels of the tree are tables: a node with too many vectors is split around a few centres
of its own, level by level, until every node fits in a block; each block holds the levels below it,
nested balls with halving radii. Pairs of nodes are followed down together, first as rows of a table
and then within pairs of blocks: a pair whose centres lie further apart than the radii and the
threshold allow is pruned, one that lies closer than they could undo is counted whole, and only
leaves compare vectors.
"""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Union, connected_components, given_back, mix64, staged, table

#: Components (vectors times dimensions) of a block and of a group that is split, at most.
BLOCK, GROUP = 1 << 18, 1 << 22
#: Vectors that choose a node's centres, centres of a node, and vectors of a leaf, at most.
SAMPLE, FAN, LEAF = 1024, 64, 12
#: Blocks that a task holds from either side, at most.
SIDE = 8
#: Nodes of one side that are held against the other side's at a time.
SLICE = 1024
#: Pairs of vectors or nodes compared in double precision at a time.
PAIRS = 1 << 17
#: Cosine to its centre under which a small ball's vector makes it wide, and radii that tell nodes apart.
WIDE, RADII = 0.97, (0.05, 0.25, 0.6)
#: Slack of distances for rounding; pairs within it are compared as vectors.
SLACK = 1e-7


def unit(rows) -> np.ndarray:
    """Rows brought to length 1, in double precision without overflow."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x, each the farthest from those before it."""
    chosen, most = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(most.argmin()))
        most = np.maximum(most, x @ x[chosen[-1]])
    return x[chosen]


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the unit vectors in the rows of x and y, row by row."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, y)))


class CoverTree:
    """Nodes in arrays: radius, range of its vectors (the first is its centre), and range of its children."""

    def __init__(self, radius, low, high, child, children):
        self.radius, self.low, self.high, self.child, self.children = radius, low, high, child, children

    @staticmethod
    def net(x: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
        """Balls of own's vectors, each within reach of its first one, which no earlier ball holds."""
        balls, rest = [], own
        while len(rest):
            first, held = rest[:SLICE], np.zeros(len(rest), bool)
            near = x[first] @ x[rest].T >= 1 - reach * reach / 2
            for k in range(len(first)):
                if not held[k]:
                    ball = near[k] & ~held
                    ball[k] = True
                    held |= ball
                    at = np.flatnonzero(ball)
                    balls.append(rest[np.concatenate([[k], at[at != k]])])
            rest = rest[~held]
        return balls

    @staticmethod
    def build(x: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of the rows of x and the order in which its leaves hold them."""
        order, nodes, level = np.arange(len(x)), [[0, len(x), 2.0, 0, 0]], [0]
        while level:
            below = []
            for k in level:
                low, high, reach = nodes[k][:3]
                if high - low <= LEAF or reach < 1e-3:
                    continue
                reach /= 2
                balls = CoverTree.net(x, order[low:high].copy(), reach)
                order[low:high] = np.concatenate(balls)
                # A few vectors far from each other are nodes of their own at once.
                balls = [part for ball in balls for part in (ball[:, None] if 1 < len(ball) <= LEAF and (x[ball] @ x[ball[0]]).min() < WIDE else [ball])]
                nodes[k][3:] = [len(nodes), len(nodes) + len(balls)]
                for ball in balls:
                    below.append(len(nodes))
                    nodes.append([low, low + len(ball), reach, 0, 0])
                    low += len(ball)
            level = below
        sorted_x = x[order]
        radius = np.array([np.sqrt(max(0.0, 2 - 2 * (sorted_x[n[0] : n[1]] @ sorted_x[n[0]]).min())) if n[1] - n[0] > 1 else 0.0 for n in nodes])
        low, high, _, child, children = np.array(nodes, object).T
        return CoverTree(radius, low.astype(np.int64), high.astype(np.int64), child.astype(np.int64), children.astype(np.int64)), order

    def parts(self, k: int) -> np.ndarray:
        return np.arange(self.child[k], self.children[k]) if self.child[k] else np.array([k])


class Vectors:
    """Unit vectors in double precision, and in single for a first look, with the weight and id of each."""

    def __init__(self, raw: np.ndarray, rep: np.ndarray, m: np.ndarray):
        self.x, self.rep, self.m = unit(raw), rep, m
        self.low = self.x.astype(np.float32)
        #: The most by which a product in single precision can be off.
        self.off = 1e-6 + 1.2e-7 * self.x.shape[1]


def near_centres(s: Vectors, ix: np.ndarray, rx: np.ndarray, t: Vectors, iy: np.ndarray, ry: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of centres no further apart than their radii and reach, with their distances.

    Nodes of like radii are held against each other by one bound on the cosine in single precision,
    then what passes by each pair's own bound in double.
    """
    kx, ky, found = np.searchsorted(RADII, rx), np.searchsorted(RADII, ry), []
    for a in np.unique(kx):
        for b in np.unique(ky):
            ia, jb = np.flatnonzero(kx == a), np.flatnonzero(ky == b)
            far = rx[ia].max() + ry[jb].max() + reach
            i, j = np.nonzero(s.low[ix[ia]] @ t.low[iy[jb]].T >= 1 - far * far / 2 - SLACK - s.off)
            i, j = ia[i], jb[j]
            for k in range(0, len(i), PAIRS):
                ik, jk = i[k : k + PAIRS], j[k : k + PAIRS]
                d = gaps(s.x[ix[ik]], t.x[iy[jk]])
                ok = d <= rx[ik] + ry[jk] + reach
                found.append((ik[ok], jk[ok], d[ok]))
    i, j, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return i, j, d


def traverse(s: CoverTree, x: Vectors, t: CoverTree, y: Vectors, cosine: float):
    """Follows all pairs of nodes of two trees; returns the weights linked to x and y, and joining links.

    With one tree, given twice, a vector isn't its own and each pair of nodes is met once.
    """
    same, reach = s is t, float(np.sqrt(2 - 2 * cosine))
    nx, ny, links, forest = np.zeros(len(x.x), np.int64), np.zeros(len(y.x), np.int64), [], Union(len(x.x) + (0 if same else len(y.x)))
    shift = 0 if same else len(x.x)

    def link(i: int, j: int):
        if forest.join(i, shift + j):
            links.append((i, j))

    def leaves(p: np.ndarray, q: np.ndarray):
        """Compares the vectors of pairs of leaves, many pairs at once."""
        step = max(1, PAIRS // (LEAF * LEAF))
        for k in range(0, len(p), step):
            pk, qk = p[k : k + step], q[k : k + step]
            wide = t.high[qk] - t.low[qk]
            each = (s.high[pk] - s.low[pk]) * wide
            pair = np.repeat(np.arange(len(pk)), each)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            u, v = s.low[pk][pair] + place // wide[pair], t.low[qk][pair] + place % wide[pair]
            near = np.concatenate([np.einsum("ij,ij->i", x.x[u[c : c + PAIRS]], y.x[v[c : c + PAIRS]]) for c in range(0, len(u), PAIRS)] or [np.empty(0)]) >= cosine
            own = same & (pk == qk)[pair]
            near &= ~(own & (u == v))
            u, v, own = u[near], v[near], own[near]
            np.add.at(nx, u, y.m[v])
            np.add.at(ny, v[~own], x.m[u[~own]])
            for i, j in zip(u.tolist(), v.tolist(), strict=True):
                link(i, j)

    todo = [(0, 0, 0)]
    while todo:
        a, b, part = todo.pop()
        pa_, pb = s.parts(a), t.parts(b)
        if part + SLICE < len(pa_):
            todo.append((a, b, part + SLICE))
        pa_ = pa_[part : part + SLICE]
        i, j, d = near_centres(x, s.low[pa_], s.radius[pa_], y, t.low[pb], t.radius[pb], reach + SLACK)
        p, q = pa_[i], pb[j]
        if same and a == b:
            d, p, q = d[p <= q], p[p <= q], q[p <= q]
        whole = d + s.radius[p] + t.radius[q] <= reach - SLACK
        deeper = ~whole & ((s.child[p] > 0) | (t.child[q] > 0))
        todo.extend((u, v, 0) for u, v in zip(p[deeper].tolist(), q[deeper].tolist(), strict=True))
        for u, v in zip(p[whole].tolist(), q[whole].tolist(), strict=True):
            lp, hp, lq, hq = s.low[u], s.high[u], t.low[v], t.high[v]
            self_pair = same and u == v
            nx[lp:hp] += y.m[lq:hq].sum() - (x.m[lp:hp] if self_pair else 0)
            if not self_pair:
                ny[lq:hq] += x.m[lp:hp].sum()
            for k in range(lp, hp):
                link(k, lq)
            for k in range(lq, hq):
                link(lp, k)
        leaves(p[~whole & ~deeper], q[~whole & ~deeper])
    return nx, ny, links


def _packed(kind: str):
    """Arrow batches with an array column v last: v as the bytes of its numbers."""

    def run(batches):
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(kind), v.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            data = pa.array([part.tobytes() for part in np.split(flat, ends[:-1])] if len(ends) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], [*batch.schema.names[:-1], "x"])

    return run


def _rows(column, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(b, kind) for b in column])


def _centres(kind: str):
    """A node's centres, from a sample of its vectors."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(_rows(pdf.sort_values("rep")["x"], kind))
        centres = farthest_first(x, int(pdf["fan"].iloc[0]))
        return pd.DataFrame({"parent": key[0], "c": np.arange(len(centres)), "centre": [r.tobytes() for r in centres]})

    return run


def _split(kind: str):
    """Each vector's nearest centre of its node, and its distance; by a hash of its id where centres are all alike."""

    def run(key: tuple, pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"node": [], "parent": [], "c": [], "rep": [], "m": [], "dim": [], "x": [], "d": []})
        centres = centres.sort_values("c")
        x, held = unit(_rows(pdf["x"], kind)), _rows(centres["centre"], "f8")
        if len(held) > 1 and gaps(held[1:], np.broadcast_to(held[0], held[1:].shape)).max() < 1e-6:
            c = (mix64(pdf["rep"].to_numpy().view(np.uint64)) % np.uint64(len(held))).astype(np.int64)
        else:
            c = (x @ held.T).argmax(axis=1)
        names = np.array([f"{key[0]}.{k:03d}" for k in range(len(held))], object)
        return pd.DataFrame({"node": names[c], "parent": key[0], "c": c, "rep": pdf["rep"], "m": pdf["m"], "dim": pdf["dim"], "x": pdf["x"], "d": gaps(x, held[c])})

    return run


def _children(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A node's children in one row; a leaf is its own."""
    pdf = pdf.sort_values("node")
    return pd.DataFrame({"parent": [key[0]], "nodes": [pdf["node"].to_list()], "leaf": [pdf["leaf"].to_list()], "radius": [pdf["radius"].to_list()], "centres": [b"".join(pdf["centre"])]})


def _descend(reach: float):
    """The pairs of children of pairs of nodes that are not pruned; whole marks those linked altogether."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rx, ry = np.asarray(r.radius, float), np.asarray(r.radius2, float)
                x, y = np.frombuffer(r.centres).reshape(len(rx), -1), np.frombuffer(r.centres2).reshape(len(ry), -1)
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))
                i, j = np.nonzero(d <= rx[:, None] + ry + reach + SLACK)
                if r.a == r.b:
                    i, j = i[i <= j], j[i <= j]
                if len(i):
                    whole = d[i, j] + rx[i] + ry[j] <= reach - SLACK
                    na, nb, la, lb = np.array(r.nodes, object), np.array(r.nodes2, object), np.array(r.leaf, bool), np.array(r.leaf2, bool)
                    swap = na[i] > nb[j]
                    yield pd.DataFrame({"a": np.where(swap, nb[j], na[i]), "b": np.where(swap, na[i], nb[j]), "leaves": la[i] & lb[j], "whole": whole})

    return run


def _block(kind: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        raw = _rows(pdf["x"], kind)
        tree, order = CoverTree.build(unit(raw))
        out = io.BytesIO()
        np.savez(out, radius=tree.radius, low=tree.low.astype("i4"), high=tree.high.astype("i4"), child=tree.child.astype("i4"), children=tree.children.astype("i4"),
                 raw=raw[order], rep=pdf["rep"].to_numpy(np.int64)[order], m=pdf["m"].to_numpy(np.int64)[order])
        return pd.DataFrame({"node": [key[0]], "data": [out.getvalue()]})

    return run


def _unpacked(data: bytes) -> tuple[CoverTree, Vectors]:
    z = np.load(io.BytesIO(data))
    tree = CoverTree(z["radius"], *(z[n].astype(np.int64) for n in ("low", "high", "child", "children")))
    return tree, Vectors(z["raw"], z["rep"], z["m"])


def _meet(cosine: float):
    """Links of the pairs of blocks in one task: n is the weight linked to a; a and b with n of 0 join components."""

    def run(key: tuple, pairs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        held = {node: _unpacked(data) for node, data in zip(blocks["node"], blocks["data"], strict=True)}
        frames = [pd.DataFrame({"a": [], "b": [], "n": []})]
        for a, b in sorted(zip(pairs["a"], pairs["b"], strict=True)):
            (s, x), (t, y) = held[a], held[b]
            nx, ny, links = traverse(s, x, t, y, cosine)
            # With one tree, each pair of nodes was met once: nx and ny are its two directions.
            for v, n in [(x, nx + ny)] if a == b else [(x, nx), (y, ny)]:
                frames.append(pd.DataFrame({"a": v.rep[n > 0], "b": None, "n": n[n > 0]}))
            if links:
                i, j = np.array(links).T
                frames.append(pd.DataFrame({"a": x.rep[i], "b": y.rep[j], "n": 0}))
        return pd.concat([f for f in frames if len(f)] or frames).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return run


def _cover(classes: DataFrame, kind: str, block: int, group: int) -> tuple[DataFrame, DataFrame, int]:
    """The tree's upper levels: vectors with their leaf node, nodes, and the number of levels under the roots.

    A node has node, parent, centre, radius, weight, first (its least id) and leaf. Every split takes
    one shuffle of the vectors still in nodes that are too large, in groups of bounded size.
    """
    live = classes.select(F.format_string("%06d", "dim").alias("node"), "rep", "m", "dim", "x")
    size = lambda df, *more: df.groupBy("node", "dim").agg(F.count("*").alias("k"), F.sum("m").alias("weight"), F.min("rep").alias("first"), *more)
    large = F.col("k") * F.col("dim") > block
    nodes = staged(size(live).withColumns({"parent": F.lit(None).cast("string"), "c": F.lit(0), "radius": F.lit(2.0), "leaf": ~large}), "vec-roots")
    # A root's centre is never asked for but where it is a leaf, which is held against nothing but itself.
    every, vectors, depth = [nodes.withColumn("centre", F.lit(None).cast("binary"))], [], 0
    while True:
        known = live.join(nodes.select("node", "k", "leaf"), "node")
        vectors.append(known.where("leaf").select("node", "rep", "m", "x"))
        if nodes.where("not leaf").isEmpty():
            break
        depth += 1
        over = known.where("not leaf").withColumn("fan", F.least(F.lit(FAN), F.ceil(F.col("k") * F.col("dim") * 2 / block)).cast("int"))
        some = over.where(F.pmod(F.xxhash64("rep", F.lit(depth)), F.ceil(F.col("k") / SAMPLE)) == 0)
        centres = staged(some.select("node", "rep", "x", "fan").groupBy("node").applyInPandas(_centres(kind), "parent string, c int, centre binary"), "vec-centres")
        parts = F.ceil(F.col("k") * F.col("dim") / group)
        rows = over.withColumn("part", F.pmod(F.xxhash64(F.lit(-depth), "rep"), parts)).select("node", "part", "rep", "m", "dim", "x")
        spread = centres.join(nodes.where("not leaf").select(F.col("node").alias("parent"), parts.alias("parts")), "parent").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        live = rows.groupBy("node", "part").cogroup(spread.select(F.col("parent").alias("node"), "part", "c", "centre").groupBy("node", "part")).applyInPandas(
            _split(kind), "node string, parent string, c int, rep long, m long, dim int, x binary, d double"
        )
        live = staged(live, "vec-level")
        nodes = staged(size(live, F.first("parent").alias("parent"), F.first("c").alias("c"), F.max("d").alias("radius")).withColumn("leaf", ~large), "vec-nodes")
        every.append(nodes.join(centres, ["parent", "c"]))
    return reduce(DataFrame.unionByName, vectors), reduce(DataFrame.unionByName, every), depth


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Links vectors with a cosine of at least `cosine` and groups those that links reach.

    vectors has vec_id (unique, not null) and embedding; other columns are ignored. Returns vec_id,
    n_links (other vectors linked directly), component_id (the smallest vec_id reachable, itself
    included) and kept (vec_id = component_id). Exact in double precision. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing, as do vectors of unlike
    lengths with each other. Equal vectors are one node of the tree with their number as weight. An
    empty table gives an empty result.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must be between 0 and 1")
    reach, given = float(np.sqrt(2 - 2 * cosine)), vectors.schema["embedding"].dataType
    kind, element = ("f4", "float") if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else ("f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("v"))
    sound = F.coalesce(F.expr("size(v) > 0 and vec_id is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) <= 1.7976931348623157e308D) and exists(v, c -> c <> 0)"), F.lit(False))
    keyed = rows.withColumn("sound", sound).withColumns({"h1": F.when(F.col("sound"), F.xxhash64("v")), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "v"))})
    merged = keyed.where("sound").groupBy("h1", "h2", F.size("v").alias("dim")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = staged(merged.mapInArrow(given_back(_packed(kind)), "h1 long, h2 long, dim int, rep long, m long, x binary"), "vec-classes")

    placed, nodes, depth = _cover(classes, kind, block, group)
    blocks = staged(placed.groupBy("node").applyInPandas(_block(kind), "node string, data binary"), "vec-blocks")

    # Pairs of nodes, from the roots down; a leaf stands for its own child.
    pairs = nodes.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("leaf").alias("leaves"), F.lit(False).alias("whole"))
    met = [pairs]
    if depth:
        listed = nodes.where("centre is not null").select("node", "leaf", "radius", "centre", F.explode(F.array_compact(F.array("parent", F.when(F.col("leaf"), F.col("node"))))).alias("parent"))
        kids = staged(listed.groupBy("parent").applyInPandas(_children, "parent string, nodes array<string>, leaf array<boolean>, radius array<double>, centres binary"), "vec-children")
        of_a, of_b = kids.withColumnRenamed("parent", "a"), kids.toDF("b", "nodes2", "leaf2", "radius2", "centres2")
        for _ in range(depth):
            pairs = staged(pairs.where("not leaves and not whole").join(of_a, "a").join(of_b, "b").mapInPandas(_descend(reach), "a string, b string, leaves boolean, whole boolean"), "vec-pairs")
            met.append(pairs)
    met = reduce(DataFrame.union, met)

    # Pairs of blocks, in tasks of a few blocks that are neighbours in the tree from either side.
    side = max(1, min(SIDE, blocks.count() // 6))
    bucket = lambda c: F.concat(F.expr(f"substring({c}, 1, length({c}) - 4)"), F.lit("/"), F.coalesce(F.expr(f"try_cast(substring({c}, -3, 3) as int) div {side}").cast("string"), F.lit("")))
    todo = met.where("leaves and not whole").select("a", "b", bucket("a").alias("x"), bucket("b").alias("y")).select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    needed = todo.select("x", "y", F.explode(F.array("a", "b")).alias("node")).distinct().join(blocks, "node")
    needed = needed.select("node", "data", F.col("x").alias("x_"), F.col("y").alias("y_"))
    found = staged(todo.groupBy("x", "y").cogroup(needed.groupBy("x_", "y_")).applyInPandas(_meet(cosine), "a long, b long, n long"), "vec-links")

    # Pairs of nodes that are linked as a whole: all vectors under one link with all under the other.
    direct = found.where("n > 0").select(F.col("a").alias("rep"), "n")
    edges = found.where("b is not null").select("a", "b")
    whole = met.where("whole")
    if depth and not whole.isEmpty():
        both = whole.select("a", "b").union(whole.where("a <> b").select("b", "a"))
        ends = nodes.select("node", "weight", "first")
        told = both.join(ends.toDF("a", "weight_a", "first_a"), "a").join(ends.toDF("b", "weight_b", "first_b"), "b")
        by_node = told.groupBy(F.col("a").alias("above")).agg(F.sum("weight_b").alias("add"), F.max((F.col("a") == F.col("b")).cast("long")).alias("own"), F.min("first_b").alias("hub"))
        under = placed.select("rep", "m", F.explode(F.expr("transform(sequence(6, length(node), 4), k -> substring(node, 1, k))")).alias("above")).join(by_node, "above")
        direct = direct.union(under.select("rep", F.col("add") - F.col("own") * F.col("m")))
        edges = edges.union(under.select("rep", "hub")).union(told.select("first_a", "first_b"))
    direct = direct.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = connected_components(edges).withColumnRenamed("node", "rep")
    part = classes.select("h1", "h2", "dim", "rep", "m").join(direct, "rep", "left").join(groups, "rep", "left")
    part = part.select("h1", "h2", F.col("dim").alias("dim_"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2", F.size("v").alias("dim_")).join(part, ["h1", "h2", "dim_"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)
