"""Document quality by hierarchical empirical Bayes.

A logistic classifier over the shape of a text (shares of letters, capitals, symbols,
repeated words, ...) gives each document's evidence. It is fitted on at most
``SAMPLE`` labelled documents picked by a hash of their id, outside the held-out fold.

Hosts and paths get posteriors from the evidence of all their documents: the mean
evidence of a host shrinks toward the global mean, that of a path toward its host's
posterior, each with a prior strength estimated from the data (method of moments over
the groups), so sparse sites say little and large ones speak for themselves. The final
log-odds combine the document's own with the path posterior's shift from the global mean; how
much each of them counts is fitted on the labelled sample.

Groups are aggregated by partial sums and counts only; a host with a third of all rows
costs one row per task before the shuffle.

Defined results: null text counts as empty; null host or path is a group of its own;
null labels are ignored; without two classes the evidence is the share of label 1 (0.5
without labels); repeated rows count one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_bytes, heavy_keys, land, spread_join

SAMPLE = 4000
FOLDS = 5


_PLAIN = re.compile(r"[\w\s.,;:'\"()!?-]+").findall


def features(text: str | None) -> list[float]:
    """The shape of a text, in numbers of comparable size."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    letters = sum(map(str.isalpha, words))
    head = [w[-1] for w in words]
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    lines = text.split("\n")
    symbols = chars - sum(map(len, _PLAIN(text)))
    return [
        1.0,
        math.log1p(len(words)) / 5,
        letters / n,
        upper / n,
        symbols / chars * 10,
        sum(not c.isalnum() and c not in ".,;:?!'\")" for c in head) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        sum(c in "!?" for c in head) / n,
        (chars - len(words)) / n / 10,
        sum(w[0].isdigit() for w in words) / n,
    ]


class Shape:
    """A logistic model over ``features``."""

    def __init__(self, weights: np.ndarray | None = None, mean: np.ndarray | None = None, scale: np.ndarray | None = None, constant: float | None = None):
        self.weights, self.mean, self.scale, self.constant = weights, mean, scale, constant

    @classmethod
    def fit(cls, texts: list[str | None], labels: np.ndarray) -> Shape:
        if len(set(labels.tolist())) < 2:
            return cls(constant=float(labels.mean()) if len(labels) else 0.5)
        x = np.array([features(t) for t in texts])
        mean, scale = x.mean(0), x.std(0) + 1e-6
        mean[0], scale[0] = 0, 1
        x = (x - mean) / scale
        y = labels.astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
            w = w - np.linalg.solve(h, x.T @ (p - y) + 1.0 * w)
        return cls(w, mean, scale)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The chance of label 1 from the text alone."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        x = (np.array([features(t) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def labelled(labels: DataFrame, id_col: str, label_col: str, sample: int = SAMPLE) -> DataFrame:
    """(_id, _label): at most ``sample`` labelled ids outside the held-out fold, by a hash."""
    i = F.col(id_col)
    return (
        labels.filter(i.isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(i))
        .select(i.alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )


def weigh(own: np.ndarray, site: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a document's own log-odds and its site's shift, and an offset, by penalised
    likelihood: without labels to tell, one, one and zero."""
    prior = np.array([1.0, 1.0, 0.0])
    if len(y) < 2 or len(set(y.tolist())) < 2:
        return prior
    x, w = np.stack([own, site, np.ones(len(y))], 1), prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + (w - prior)), -1, 1)
    return np.array([max(w[0], 0.0), max(w[1], 0.0), w[2]])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Shape:
    picked, i = labelled(labels, id_col, label_col, sample), F.col(id_col)
    rows = docs.select(i.alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").orderBy("_id", "_label", F.sha2("_text", 256)).select("_text", "_label").toArrow()
    return Shape.fit(rows["_text"].to_pylist(), np.array(rows["_label"].to_pylist(), int))


def _strength(groups: DataFrame, mean: str, var: str, n: str, prior: Column) -> float:
    """Prior strength of groups by moments: within over between variance.

    One row comes back, whatever the number of groups.
    """
    d = F.col(mean) - prior
    row = groups.agg(
        F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * d * d).alias("between"), F.sum(F.col(n) * F.col(var)).alias("within"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col(n) * F.col(n)).alias("nn"),
    ).first()
    if not row["n"] or row["k"] < 2:
        return 1e6
    within = (row["within"] or 0.0) / row["n"]
    effective = row["n"] - row["nn"] / row["n"]
    between = max(0.0, (row["between"] - (row["k"] - 1) * within) / effective) if effective > 0 else 0.0
    return min(1e6, within / between) if between > 0 else 1e6


def classify(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """One row per document: id, held_out, evidence, host_posterior, path_posterior, score, kept."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(docs, labels, id_col, text_col, label_col)
    shared = broadcast_bytes(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.evidence(batch.column(3).to_pylist()), pa.float64())], ["_id", "_host", "_path", "_p"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path"), F.col(text_col).alias("_text"))
    seen = land(rows.mapInArrow(run, f"_id {kind}, _host string, _path string, _p double"), "quality-evidence")
    paths = land(seen.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("ss")), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = float(total["s"] / total["n"]) if total["n"] else 0.5
    moments = lambda df: df.withColumn("m", F.col("s") / F.col("n")).withColumn("v", F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.col("m") * F.col("m")))
    hosts = moments(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    host_strength = _strength(hosts, "m", "v", "n", F.lit(overall))
    hosts = hosts.select("_host", ((F.col("s") + host_strength * overall) / (F.col("n") + host_strength)).alias("host_posterior"))
    nested = moments(paths).join(hosts, "_host")
    path_strength = _strength(nested, "m", "v", "n", F.col("host_posterior"))
    nested = nested.select("_host", "_path", "host_posterior", ((F.col("s") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)).alias("path_posterior"))
    clip = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    odds = lambda p: F.log(clip(p) / (1 - clip(p)))
    nested = land(nested, "quality-posteriors")
    joined = spread_join(seen, nested, ["_host", "_path"], heavy_keys(paths.select("_host", "_path", "n"), "n"), by=["_id", "_p"])
    joined = joined.withColumn("_own", odds(F.col("_p"))).withColumn("_site", odds(F.col("path_posterior")) - odds(F.lit(overall)))
    fitted = joined.select("_id", "_own", "_site").join(F.broadcast(labelled(labels, id_col, label_col)), "_id").orderBy("_id", "_label", "_own", "_site").toArrow()
    own, site, offset = weigh(fitted["_own"].to_numpy(), fitted["_site"].to_numpy(), fitted["_label"].to_numpy()).tolist()
    z = own * F.col("_own") + site * F.col("_site") + offset
    score = 1 / (1 + F.exp(-z))
    return joined.select(
        F.col("_id").alias(id_col), F.coalesce(held_out(F.col("_id")), F.lit(False)).alias("held_out"), F.col("_p").alias("evidence"),
        "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("kept"),
    )
