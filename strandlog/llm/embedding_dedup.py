"""Near-duplicate vectors by a random-projection tree forest.

Every tree splits the unit vectors recursively along random directions, one direction per
level. Vectors whose projection lies within the spill margin of a split go to both sides.
Vectors that meet in a leaf of any tree are compared exactly, in double precision. Of all
the leaves a linked pair shares, only the first one (by tree, then by leaf) reports it, so a
leaf's task adds up its part of every vector's number of links and hands on one row per vector: its
links there, and the smallest vector it is connected with there. Pairs themselves never travel.

Unit vectors and directions are rounded to multiples of 2**-15 before they are multiplied, which
makes projections exact in double precision: every task that asks for a vector's leaves gets
the same ones.

What the driver holds is bounded: directions (trees x depth x dimension) and split points
for the first levels, fitted on a bounded sample (``SAMPLE`` vectors); deeper levels split
at zero. Spill margin and number of trees are fitted on pairs at about the threshold, in
groups from the sample's densest vectors to its loneliest: the margin is the cheapest of a
few, and trees are added until the worst group misses a pair in all trees with probability
of about ``MISS``. Pairs above the threshold are missed far less. This goes for the ``FITTED_DIMS`` commonest
dimensions of a table; others get trees by rule: splits at zero and a margin that a threshold pair
overruns with about 1e-6 a level.

Equal vectors form one class, found by a 128-bit digest, which takes part once and counts as often as it occurs. A
leaf larger than ``LEAF_ROWS`` (a dense region that no split divides) is compared in
blocks of that size, one task per pair of blocks, so no group is unbounded.

Defined results: vectors that are null, zero or hold null or non-finite components link
with nothing, nor do rows with a null id; vectors of different lengths never link; repeated rows count one by one, and rows
of one id with different vectors take part each for itself; an
empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_bytes, heavy_keys, land, spread_join
from .components import components

#: Vectors the split points are fitted on, at most.
SAMPLE = 16_384
#: Levels with fitted split points, at most.
FITTED = 12
#: Dimensions with fitted trees; vectors of rarer ones get trees by rule, of this margin (as ``SPILLS``) and number.
FITTED_DIMS = 64
RULE_SPILL, RULE_TREES = 2.5, 3
#: Vectors in a leaf, about; every table is split ``LEAST_DEPTH`` times at least.
LEAF_TARGET = 1024
LEAST_DEPTH = 2
LEAF_ROWS = 2048
#: Vectors and directions are rounded to multiples of 1 / GRID.
GRID = float(1 << 15)
MISS = 1e-5
#: Spill margins to choose from, in standard deviations of a threshold pair's projected difference.
SPILLS = (0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.5, 4.0)
LEAST_TREES = 4
#: Trees that judge a margin; pairs of each group they are judged on.
PILOT = 4
PROBES = 512
#: A routed row costs as much as so many comparisons.
ROW = 500


def threshold_pairs(sample: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of pairs at about the threshold, from the sample's densest vectors to its loneliest:
    the sample's own pairs where it has enough, and pairs made around its vectors."""
    n = len(sample)
    few = sample[rng.permutation(n)[:2048]]
    near = min(16, len(few))
    dense = np.concatenate([np.partition(sample[k : k + 1024] @ few.T, -near, axis=1)[:, -near:].mean(axis=1) for k in range(0, n, 1024)])
    order = np.argsort(-dense, kind="stable")
    bounds = sorted({0, *(n >> k for k in range(7))})
    groups = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own = sample[rng.choice(order[lo:hi], PROBES)]
        r = rng.standard_normal(own.shape)
        r -= (r * own).sum(axis=1, keepdims=True) * own
        r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)
        groups.append((math.sqrt((1 + cosine) / 2) * own + math.sqrt((1 - cosine) / 2) * r, math.sqrt((1 + cosine) / 2) * own - math.sqrt((1 - cosine) / 2) * r))
        c = own @ sample.T
        i, j = np.nonzero((c >= cosine) & (c <= cosine + 0.1 * (1 - cosine)))
        if len(i) >= 32:
            some = rng.permutation(len(i))[:PROBES]
            groups.append((own[i[some]], sample[j[some]]))
    return groups


class Forest:
    """Trees for the vectors of one dimension."""

    def __init__(self, dim: int, n: int, sample: np.ndarray | None, cosine: float, seed: int = 7):
        self.dim = dim
        self.depth = depth = max(LEAST_DEPTH, math.ceil(math.log2(max(1, n) / LEAF_TARGET)))
        sigma = math.sqrt(2 * (1 - cosine) / dim)
        rng = np.random.default_rng(seed)
        unit = lambda *shape: (lambda d: np.rint(GRID * d / np.linalg.norm(d, axis=-1, keepdims=True)) / GRID)(rng.standard_normal(shape))
        if sample is None:
            self.directions, self.splits, self.margin = unit(RULE_TREES, depth, dim), [[]] * RULE_TREES, RULE_SPILL * sigma
        else:
            pairs = threshold_pairs(sample, cosine, rng)
            few = sample[rng.permutation(len(sample))[:PROBES]]
            best = None
            for spill in SPILLS:  # the margin that costs least, by a few trees
                pilot = np.random.default_rng(seed).standard_normal((PILOT, depth, dim))
                self.directions = np.rint(GRID * pilot / np.linalg.norm(pilot, axis=-1, keepdims=True)) / GRID
                self.splits, self.margin = [self._fit(sample @ d.T) for d in self.directions], spill * sigma
                missed = sum(self.missed(pairs, t) for t in range(PILOT)).max() / PILOT
                leaves = [self.walk(few, t)[1] for t in range(PILOT)]
                met = sum(float((np.bincount(x) ** 2.0).sum()) for x in leaves) * n / len(few) ** 2
                cost = (ROW * sum(map(len, leaves)) / len(few) + met) * (math.log(MISS) / missed if missed else math.inf)
                if best is None or cost < best[0]:
                    best = cost, spill
            self.margin = best[1] * sigma
            self.directions, self.splits, missed = np.zeros((0, depth, dim)), [], np.zeros(len(pairs))
            while len(self.splits) < LEAST_TREES or missed.max() > math.log(MISS):
                self.directions = np.concatenate([self.directions, unit(1, depth, dim)])
                self.splits.append(self._fit(sample @ self.directions[-1].T))
                missed += self.missed(pairs, -1)
        self.trees = len(self.splits)

    def missed(self, pairs: list[tuple[np.ndarray, np.ndarray]], t: int) -> np.ndarray:
        """The log of the share of each group's pairs that share no leaf of tree ``t``."""
        out = []
        for x, y in pairs:
            meet = np.intersect1d(*((lambda row, leaf: row << 40 | leaf)(*self.walk(v, t)) for v in (x, y))) >> 40
            out.append(math.log1p(-len(np.unique(meet)) / (len(x) + 1)))
        return np.array(out)

    def _fit(self, proj: np.ndarray) -> list[np.ndarray]:
        """Medians of the sample, node by node, for the first levels."""
        node = np.zeros(len(proj), np.int64)
        out = []
        for level in range(min(self.depth, FITTED)):
            at = np.zeros(1 << level)
            order = np.argsort(node, kind="stable")
            starts = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k in range(1 << level):
                own = proj[order[starts[k] : starts[k + 1]], level]
                if len(own) >= 8:
                    at[k] = np.median(own)
            out.append(at)
            node = 2 * node + (proj[:, level] > at[node])
        return out

    def walk(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of tree ``t`` that a vector reaches."""
        proj = np.rint(unit * GRID) / GRID @ self.directions[t].T  # exact, whatever the order of the sums
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for level in range(self.depth):
            at = self.splits[t][level][node] if level < len(self.splits[t]) else 0.0
            off = proj[row, level] - at
            left, right = off <= self.margin, off > -self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) for every leaf that a vector reaches."""
        walks = [self.walk(unit, t) for t in range(self.trees)]
        rows, leaves = (np.concatenate(c) for c in zip(*walks))
        return rows, np.repeat(np.arange(self.trees, dtype=np.int32), [len(r) for r, _ in walks]), leaves


def to_unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least the threshold; within x (i < j) if y is None.

    Single precision tells the pairs that are clearly above; those within 1e-4 of the threshold are computed in double.
    """
    other = x if y is None else y
    f, g = x.astype(np.float32), other.astype(np.float32)
    found_i, found_j = [], []
    for k in range(0, len(f), 256):
        at = k if y is None else 0
        c = f[k : k + 256] @ g[at:].T
        i, j = np.nonzero(c >= cosine - 1e-4)
        sure = c[i, j] >= cosine + 1e-4
        i, j = i + k, j + at
        if y is None:
            i, j, sure = (v[i < j] for v in (i, j, sure))
        near = np.flatnonzero(~sure)
        for m in range(0, len(near), 65536):
            own = near[m : m + 65536]
            sure[own] = np.einsum("ij,ij->i", x[i[own]], other[j[own]]) >= cosine
        found_i.append(i[sure])
        found_j.append(j[sure])
    none = [np.zeros(0, int)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return to_unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False)), dim)


def first_met(model: Forest, unit: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Of the pairs (a, b), which meet in ``leaf`` of ``tree``, those that share no leaf before it."""
    open_ = np.arange(len(a))
    for t in range(tree + 1):
        if not len(open_):
            break
        used, at = np.unique(np.concatenate([a[open_], b[open_]]), return_inverse=True)
        row, node = model.walk(unit[used], t)
        leaves, node = np.unique(node, return_inverse=True)
        if t == tree:  # smaller leaves of the same tree only
            row, node = row[leaves[node] < leaf], node[leaves[node] < leaf]
        if not len(row):
            continue
        held = np.zeros((len(used), len(leaves)), bool)
        held[row, node] = True
        held = np.packbits(held, axis=1)
        x, y = at[: len(open_)], at[len(open_) :]
        met = np.concatenate([(held[x[k : k + 65536]] & held[y[k : k + 65536]]).any(axis=1) for k in range(0, len(x), 65536)])
        open_ = open_[~met]
    return open_


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one it is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def class_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(_node, _links, _least): for each leaf and each of its classes that links there, the rows it
    links with for the first time and the smallest class it is connected with. ``classes`` has
    _node, _times and _v (clean arrays)."""
    spark = classes.sparkSession
    sized = classes.select("_node", "_v", F.size("_v").alias("_dim"))
    sizes = land(sized.groupBy("_dim").agg(F.count(F.lit(1)).alias("_many")), "vector-dims")
    few = sizes.count() <= 4096  # dimensions
    models = {}
    for r in sizes.orderBy(F.desc("_many"), "_dim").limit(FITTED_DIMS).collect():
        dim, n = r["_dim"], r["_many"]
        picked = sized.filter(F.col("_dim") == dim)
        if n > SAMPLE:
            picked = picked.sample(min(1.0, 1.2 * SAMPLE / n), 11).limit(SAMPLE)
        sample = picked.select("_node", "_v").toArrow().sort_by("_node").column("_v").combine_chunks()
        models[dim] = Forest(dim, n, _vectors(sample, dim) if len(sample) else None, cosine)
    shared = broadcast_bytes(spark, models)

    def model_of(dim: int, many: int) -> Forest:
        return shared.value.get(dim) or Forest(dim, many, None, cosine)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, many = batch.column(0), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = pa.array(at)
                model, unit = model_of(dim, int(many[at[0]])), _vectors(batch.column(1).take(own), dim)
                mine = ids.take(own)
                for t in range(model.trees):
                    for k in range(0, len(own), 2048):
                        row, leaf = model.walk(unit[k : k + 2048], t)
                        yield pa.RecordBatch.from_arrays(
                            [mine.take(pa.array(row + k)), pa.array(np.full(len(row), dim, np.int32)), pa.array(np.full(len(row), t, np.int32)), pa.array(leaf, pa.int64())],
                            ["_node", "_dim", "_tree", "_leaf"],
                        )

    dealt = sized.join(F.broadcast(sizes), "_dim") if few else sized.join(sizes, "_dim")
    routed = land(dealt.select("_node", "_v", "_dim", "_many").mapInArrow(route, "_node long, _dim int, _tree int, _leaf long"), "leaves")
    leaf = ["_dim", "_tree", "_leaf"]
    counts = land(routed.groupBy(*leaf).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "leaf-sizes")
    blocks = counts.withColumn("_blocks", F.ceil(F.col("_n") / LEAF_ROWS).cast("int"))
    placed = (
        spread_join(routed, blocks.drop("_n"), leaf, heavy_keys(counts, "_n"))
        .withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("_node", *leaf, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    )
    many = sizes.select("_dim", "_many")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, tree, at, i, j, n = (group.column(c)[0].as_py() for c in ("_dim", "_tree", "_leaf", "_i", "_j", "_many"))
        x, ids, own = _vectors(group.column("_v").combine_chunks(), dim), group.column("_node").to_numpy(), group.column("_own").to_numpy()
        if i == j:
            a, b = linked(x, None, cosine)
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = linked(x[left], x[right], cosine) if len(left) and len(right) else (np.zeros(0, int), np.zeros(0, int))
            a, b = left[a], right[b]
        new = first_met(model_of(dim, n), x, a, b, tree, at)
        a, b = a[new], b[new]
        times = group.column("_times").to_numpy()
        links = np.bincount(a, times[b], len(ids)) + np.bincount(b, times[a], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        least = ids[order][smallest(len(ids), place[a], place[b])[place]]
        hit = np.flatnonzero(links > 0)
        return pa.table({"_node": ids[hit], "_links": links[hit].astype(np.int64), "_least": least[hit]})

    met = placed.join(classes.select("_node", "_times", "_v"), "_node").join(F.broadcast(many) if few else many, "_dim")
    return land(met.groupBy(*leaf, "_i", "_j").applyInArrow(compare, "_node long, _links long, _least long"), "vector-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, class_id (vectors equal to it)."""
    v, i = F.col(vector_col), F.col(id_col)
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)
    clean = v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0) & i.isNotNull()
    digest = [F.xxhash64("_v").alias("_k1"), F.xxhash64(F.lit(0x5EED), F.col("_v"), F.lit(1)).alias("_k2")]
    rows = vectors.select(i.alias("_id"), v.alias("_v"), F.coalesce(clean, F.lit(False)).alias("_clean"))
    usable = rows.filter("_clean").select("_id", "_v", *digest)
    key = ["_k1", "_k2"]
    grouped = usable.groupBy(*key).agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_times"), F.any_value("_v").alias("_v"))
    classes = land(grouped.select(F.monotonically_increasing_id().alias("_node"), *key, "_class", "_times", "_v"), "vector-classes")
    links = class_links(classes, cosine)
    degree = links.groupBy("_node").agg(F.sum("_links").alias("_degree"))
    reach = components(links.select(F.col("_node").alias("src"), F.col("_least").alias("dst"))).select(F.col("node").alias("_node"), F.col("component").alias("_root"))
    placed = classes.drop("_v").join(reach, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    least = placed.groupBy("_root").agg(F.min("_class").alias("_component"))
    told = land(
        placed.join(least, "_root").join(degree, "_node", "left")
        .select(*key, "_class", "_times", (F.coalesce("_degree", F.lit(0)) + F.col("_times") - 1).cast("long").alias("_links"), "_component"),
        "vector-told",
    )
    heavy = heavy_keys(told.select(*key, F.col("_times").alias("_rows")))
    with_class = spread_join(usable.select("_id", *key), told.drop("_times"), key, heavy).select("_id", "_links", "_component", "_class")
    rest = rows.filter(~F.col("_clean")).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"), F.col("_id").alias("_class"))
    return with_class.unionByName(rest).select(
        F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_component")).alias("kept"), F.col("_class").alias("class_id"),
    )
