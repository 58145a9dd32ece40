"""Near-duplicate documents by an LSH forest over min-hash signatures.

Each document is the set of its word shingles. Documents with equal sets form one class,
which takes part once. The forest reads a class's signature in ``TREES`` orders; each
starts with ``DEPTH`` min-hashes of its own, which no other order starts with, and goes on
with a permutation of the others.

A tree is the classes sorted by their signature in its order. Classes whose longest common
prefix reaches ``DEPTH`` min-hashes are one region. The depth adapts region by region: one
that holds more than ``REGION`` classes is taken apart by its next min-hashes (``LEVELS``), and the next, until its
parts are small or the last level is reached. In a part, pairs of sorted neighbours come first, by the
length of their common prefix, then all others by falling estimate; a pair whose ends are
already connected is passed over, so a region of near copies costs about one confirmation a
document and never lists its pairs. Links are confirmed on the full shingle sets, rebuilt
from the texts.

Going deeper loses pairs, so depth only settles what is confirmed first: regions that were
taken apart and still hold more than one component are then taken as a whole, in blocks,
one task per pair of blocks, and only pairs across components are looked at.

Recall: a pair at the threshold of 0.8 shares a region of a tree with probability 0.8**4 and one
of 16 regions, which share no min-hash, with 0.9998, whatever the regions' sizes. Pairs are
dropped unconfirmed only if their estimate over ``SIGNATURE`` min-hashes lies below ``LEAST`` of the
threshold, over five standard deviations away.

Defined results: null or wordless texts have no shingles and link with nothing, nor do rows with a null id; texts of
fewer words than a shingle are one shingle; rows repeated under one id are one class where their sets are
equal, and rows of one id with different sets take part each for itself; an empty table
gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from ._common import fresh, heavy_keys, land, once, row_key, ship, spread_join, unland
from .components import components

SIGNATURE = 64
TREES = 16
DEPTH = 4
#: Depths that a region may go to.
LEVELS = (5, 6, 8, 10, 12, 16)
#: Classes from which on a region is taken apart.
REGION = 1024
#: Classes and bytes of text of a block.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Estimates below this share of the threshold are not confirmed.
LEAST = 0.66
#: Trees of each round: the first ones connect most groups.
ROUNDS = ((0, 1), tuple(range(2, TREES)))


def orders() -> np.ndarray:
    """The places in the signature that each tree reads, in its order."""
    rng = np.random.default_rng(17)
    out = []
    for t in range(TREES):
        own = np.arange(t * DEPTH, (t + 1) * DEPTH)
        out.append(np.concatenate([own, rng.permutation(np.setdiff1d(np.arange(SIGNATURE), own))])[: LEVELS[-1]])
    return np.array(out)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(_id, _h, _n, _digest, _sig): hash of the text, set size, digest of the set, signature."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingles.shingle_sets(batch.column(2).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([shingles.signature(s, SIGNATURE).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["_id", "_h", "_n", "_digest", "_sig"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, _h long, _n long, _digest binary, _sig binary")


def label(tree: np.ndarray, depth: int):
    """The first ``depth`` min-hashes of a signature in a tree's order; they sort as their bytes do."""
    return F.concat(*(F.substring("_sig", 4 * int(k) + 1, 4) for k in tree[:depth]))


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_node, _tree, _key, _n) small regions and parts, (the same) regions that were taken apart).

    ``_key`` is the hash of the common prefix. Level by level, what is still too large reads some
    min-hashes more; counts are partial sums, so no level gathers a region in a task.
    """
    order = orders()
    spots = F.array(*(F.struct(F.lit(t).alias("_tree"), F.xxhash64(label(order[t], DEPTH)).alias("_key")) for t in range(TREES)))
    rows = classes.select("_node", F.explode(spots).alias("s")).select("_node", "s.*")
    region = ["_tree", "_key"]
    told = land(rows.groupBy(*region).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "region-sizes")
    met = land(spread_join(rows, told, region, heavy_keys(told, "_n")).select("_node", *region, "_n"), "regions")
    whole = met.filter(F.col("_n") > REGION)
    parts = [met.filter(F.col("_n") <= REGION)]
    open_, depth = whole.join(classes.select("_node", "_sig"), "_node"), DEPTH
    for level in LEVELS:
        if open_.isEmpty():
            break
        more = [label(order[t][depth:level], level - depth) for t in range(TREES)]
        next_ = F.xxhash64("_key", F.coalesce(*(F.when(F.col("_tree") == t, more[t]) for t in range(TREES))))
        depth = level
        deeper = open_.select("_node", "_sig", "_tree", next_.alias("_key"))
        sizes = land(deeper.groupBy(*region).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "region-sizes")
        deeper = land(spread_join(deeper, sizes, region, heavy_keys(sizes, "_n")).select("_node", "_sig", *region, "_n"), "regions")
        last = level == LEVELS[-1]
        parts.append((deeper if last else deeper.filter(F.col("_n") <= REGION)).select(*met.columns))
        open_ = deeper.filter(F.col("_n") > REGION)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, whole


def connect(sig: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray | None, percent: int, sets, order: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links that join different components, enough to connect all that link.

    ``sets(rows)`` gives the shingle sets of some rows; ``side`` (0 or 1 per row) restricts pairs to those
    across the sides; ``order`` is the tree's order of the min-hashes, whose sorted neighbours come first. What is
    held at a time is a row's candidates, never the pairs of a region.
    """
    n = len(sig)
    _, comp = np.unique(comp, return_inverse=True)
    parent = np.arange(int(comp.max()) + 1)
    links: list[tuple[int, int]] = []
    known: dict[int, np.ndarray] = {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return int(a)

    def fits(i, j):
        return (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & ((side[i] != side[j]) if side is not None else True)

    def confirm(i: int, j: int) -> None:
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b and shingles.similar(known[i], known[j], percent):
            parent[max(a, b)] = min(a, b)
            links.append((i, j))

    def learn(rows) -> None:
        new = [r for r in rows if r not in known]
        for k in range(0, len(new), 256):
            some = new[k : k + 256]
            known.update(zip(some, sets(some)))

    if order is not None and side is None:  # neighbours in the tree's sorted order, longest common prefix first
        own = sig[:, order]
        ranked = np.lexsort(own.T[::-1])
        a, b = ranked[:-1], ranked[1:]
        prefix = np.cumprod(own[a] == own[b], axis=1).sum(axis=1)
        near = np.flatnonzero((comp[a] != comp[b]) & fits(a, b) & ((sig[a] == sig[b]).mean(axis=1) >= LEAST * percent / 100))
        near = near[np.argsort(-prefix[near], kind="stable")]
        learn(np.unique(np.concatenate([a[near], b[near]])).tolist())
        for k in near.tolist():
            confirm(int(a[k]), int(b[k]))
    likely, least = 0.9 * percent / 100, LEAST * percent / 100
    doubtful = []  # rows with candidates that the first pass leaves
    for first in (True, False):
        for i in range(n - 1) if first else doubtful:
            root = parent[comp]
            j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            j = j[fits(i, j)] if len(j) else j
            if not len(j):
                continue
            e = (sig[j] == sig[i]).mean(axis=1)
            good = e >= (likely if first else least)
            if first and (e >= least).sum() > good.sum():
                doubtful.append(i)
            j, e = j[good], e[good]
            if not len(j):
                continue
            learn([i, *j.tolist()])
            for x in j[np.argsort(-e, kind="stable")].tolist():
                confirm(i, x)
            parent[:] = [find(x) for x in range(len(parent))]
    return links


def confirmed(met: DataFrame, texts: DataFrame, comps: DataFrame | None, words: int, percent: int) -> DataFrame:
    """(src, dst): links found in the regions ``met`` (_node, _tree, _key, _n)."""
    region = ["_tree", "_key"]
    if comps is None:
        rows = met.withColumn("_comp", F.col("_node"))
    else:
        rows = met.join(comps.select(F.col("node").alias("_node"), F.col("component").alias("_comp")), "_node", "left").withColumn("_comp", F.coalesce("_comp", "_node"))
    rows = land(rows.join(texts.select("_node", "_bytes"), "_node"), "region-rows")
    open_ = land(
        rows.groupBy(*region).agg(F.count(F.lit(1)).alias("_many"), F.min("_comp").alias("_a"), F.max("_comp").alias("_b"), F.sum("_bytes").alias("_sum")).filter("_a <> _b")
        .select(*region, "_many", F.ceil(F.greatest(F.col("_many") / BLOCK, F.col("_sum") / BLOCK_BYTES)).cast("int").alias("_blocks")),
        "open-regions",
    )
    placed = (
        spread_join(rows, open_.drop("_many"), region, heavy_keys(open_.select(*region, "_many"), "_many"))
        .withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("_node", "_comp", *region, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    )
    order = orders()

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("_node").combine_chunks()
        ids, comp, own, size = (group.column(c).to_numpy() for c in ("_node", "_comp", "_own", "_size"))
        if len(ids) < 2:
            return pa.table({"src": ids[:0], "dst": ids[:0]})
        text = group.column("_text")
        sig = np.frombuffer(b"".join(group.column("_sig").to_pylist()), ">u4").astype(np.uint32).reshape(len(ids), SIGNATURE)
        across = group.column("_i")[0].as_py() != group.column("_j")[0].as_py()
        links = connect(
            sig, size, comp, (own == own.min()).astype(int) if across else None, percent,
            lambda some: shingles.shingle_sets([text[r].as_py() for r in some], words), order[group.column("_tree")[0].as_py()],
        )
        a = np.array([x for x, _ in links], int)
        b = np.array([x for _, x in links], int)
        return pa.table({"src": ids[a], "dst": ids[b]})

    found = placed.join(texts.drop("_bytes"), "_node").groupBy(*region, "_i", "_j").applyInArrow(work, "src long, dst long")
    links = land(found.distinct(), "near-links")
    unland(rows, open_)
    return links


def members(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per document: _id, _h, _n, _component and _class (smallest ids), _first (whether it is its
    component's first text), null _first without shingles or id."""
    sketch = land(sketches(docs, id_col, text_col, words), "sketches")
    whole = F.col("_n").cast("boolean") & F.col("_id").isNotNull()
    classes = land(
        sketch.filter(whole).groupBy("_digest").agg(F.min(F.struct("_id", "_h", "_sig", "_n")).alias("_f"))
        .select(F.monotonically_increasing_id().alias("_node"), "_digest", F.col("_f._id").alias("_id"), F.col("_f._h").alias("_h"), F.col("_f._sig").alias("_sig"), F.col("_f._n").alias("_size")),
        "classes",
    )
    parts, taken = regions(classes)
    asked = parts.select("_node").unionByName(taken.select("_node")).distinct()
    wanted = classes.join(asked, "_node").select("_node", "_id", "_h", "_sig", "_size")
    text = F.col(text_col)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.octet_length(text).alias("_bytes"), text.alias("_text"))
    texts = land(texts.join(wanted, ["_id", "_h"]).dropDuplicates(["_node"]).select("_node", "_size", "_sig", "_bytes", "_text"), "region-texts")
    links = comps = None
    for met in (*(parts.filter(F.col("_tree").isin(*trees)) for trees in ROUNDS), taken):
        if met.isEmpty():
            continue
        new = confirmed(met, texts, comps, words, percent)
        if links is not None and new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        comps = components(links)
    unland(texts)
    told = classes.select("_node", "_digest", "_id", "_h")
    if comps is None:
        told = told.withColumn("_root", F.col("_node"))
    else:
        told = told.join(comps.select(F.col("node").alias("_node"), F.col("component").alias("_root")), "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    # a component's first text, by id and hash; partial minima, so a large component is no task's work
    tops = told.groupBy("_root").agg(F.min(F.struct("_id", "_h")).alias("_top"))
    told = land(told.join(tops, "_root").select("_digest", F.col("_id").alias("_class"), F.col("_top._id").alias("_component"), F.col("_top._h").alias("_top_h")), "near-classes")
    copies = sketch.filter(whole).groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
    known = spread_join(sketch.filter(whole).drop("_sig"), told, ["_digest"], heavy_keys(copies), by=["_id", "_h"])
    known = known.select("_id", "_h", "_n", "_component", "_class", ((F.col("_id") == F.col("_component")) & (F.col("_h") == F.col("_top_h"))).alias("_first"))
    bare = sketch.filter(~whole).select("_id", "_h", "_n", F.col("_id").alias("_component"), F.col("_id").alias("_class"), F.lit(None).cast("boolean").alias("_first"))
    out = land(known.unionByName(bare), "near-members")
    unland(sketch, classes, told)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, class_id."""
    return members(docs, id_col, text_col, words, percent).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_component")).alias("kept"), F.col("_class").alias("class_id"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: the one with the smallest id.

    Rows that link with nothing (no words, null id) stay, once for each pair of id and text.
    """
    key = fresh("_row_key", docs)
    found = members(docs, id_col, text_col, words, percent).filter("coalesce(_first, true)").select(row_key(F.col("_id"), F.col("_h")).alias(key)).distinct()
    return once(docs.withColumn(key, row_key(F.col(id_col), F.xxhash64(text_col))), key).join(found, key, "left_semi").select(*docs.columns)
