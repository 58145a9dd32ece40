"""Toxicity scores from subword bags.

A word's vector is the average of the embeddings of its character n-grams (with edge marks), hashed to
a fixed number of buckets, so an unseen misspelling shares most of its vector with the word
it hides. A linear softmax over that average says how likely the word is toxic, and a
document's log-odds are linear in the expected number of toxic words and the log of the
number of words. Embeddings, softmax and document layer are trained jointly by Adam in
numpy on the driver, on at most ``SAMPLE`` labelled documents picked by a hash of their id;
that is the only bounded sample, the scores read every whole text.

Held out are the labelled rows whose crc32(id as text) modulo ``FOLDS`` is 0; no label of
theirs is read. Labels, language, source and id are never inputs of a score.

Defined results: null or wordless texts score by the document layer's offset alone; null
labels are left out of training, as are labels without a document; several labels of one
id count each; without two classes to learn from every score is the share of label 1
(0 without labels); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_bytes

SAMPLE = 6000
FOLDS = 5
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
STEPS = 120
#: Characters of text that are worked on at once.
STEP = 1 << 17
WORD, GAP = re.compile(r"\w+"), re.compile(r"\W")
_FACTORS = np.random.default_rng(21).integers(1, 1 << 63, 1 + max(GRAMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_wordy: list[np.ndarray] = []


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, lower-cased: their characters one word after the other, their lengths, and
    the text each is of. A word is a run of letters, digits and underscores, as in ``WORD``."""
    if not _wordy:
        _wordy.append(np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)]))
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = _wordy[0][codes]
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    stops = np.cumsum(np.array([len(t) + 1 for t in low], np.int64)) if low else np.zeros(0, np.int64)
    return codes[ink], ends - starts, np.searchsorted(stops, starts, side="right")


def grams(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the character n-grams of words, with edge marks; every word has one at least."""
    n = len(lengths)
    marked = np.zeros(len(codes) + 2 * n, np.uint64)
    word = np.repeat(np.arange(n), lengths + 2)
    first = np.cumsum(lengths + 2) - lengths - 2
    marked[first], marked[first + lengths + 1] = 60, 62  # < and >
    inner = np.ones(len(marked), bool)
    inner[first] = inner[first + lengths + 1] = False
    marked[inner] = codes
    out, of = [], []
    for g in GRAMS:
        own = np.flatnonzero(word[: len(word) - g + 1] == word[g - 1 :]) if len(word) >= g else np.zeros(0, np.int64)
        h = np.full(len(own), int(_FACTORS[0]) * g % (1 << 64), np.uint64)
        for k in range(g):
            h += marked[own + k] * _FACTORS[1 + k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - 17)).astype(np.int32))
        of.append(word[own])
    return np.concatenate(out), np.concatenate(of)


class Model:
    """Subword embeddings, linear softmax and document layer."""

    def __init__(self):
        rng = np.random.default_rng(3)
        self.e = (rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32)
        self.w = rng.standard_normal((DIM, 2)).astype(np.float32)
        self.b = np.float32(-5.0)
        self.scale, self.offset = np.float32(3.0), np.float32(-4.0)
        self.length = np.float32(0.0)
        self.constant: float | None = None

    def __getstate__(self):
        return {**self.__dict__, "e": None, "margin": self.e @ (self.w[:, 1] - self.w[:, 0])} if self.e is not None else self.__dict__

    def fit(self, texts: Iterable[str | None], labels: np.ndarray, steps: int = STEPS, l2: float = 2e-6, rate: float = 0.05, log=None) -> Model:
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return self
        vocabulary: dict[str, int] = {}
        docs, ids, counts = [], [], []
        for d, t in enumerate(texts):
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall((t or "").lower())]
            own, times = np.unique(np.array(own, np.int32), return_counts=True)
            ids.append(own)
            docs.append(np.full(len(own), d, np.int32))
            counts.append(times.astype(np.float32))
        doc, word, count = np.concatenate(docs), np.concatenate(ids), np.concatenate(counts)
        del docs, ids, counts
        flat, sizes, known = [], [], list(vocabulary)
        del vocabulary
        for at in range(0, len(known), 1 << 14):
            codes, lengths, _ = words(known[at : at + (1 << 14)])
            buckets, of = grams(codes, lengths)
            order = np.argsort(of, kind="stable")  # word by word
            flat.append(buckets[order])
            sizes.append(np.bincount(of, minlength=len(lengths)).astype(np.int32))
        flat, sizes = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (flat, sizes))
        ends = np.cumsum(sizes, dtype=np.int64)
        del known
        # words by parts of about a million n-grams, so that no step needs arrays of them all
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) if len(ends) else 0, 1 << 20))).tolist(), len(sizes)]
        parts = [(a, b, slice(int(ends[a] - sizes[a]), int(ends[b - 1]))) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
        y = labels.astype(np.float32)
        n = len(y)
        long_ = np.log1p(np.bincount(doc, count, n))
        state: dict[str, list] = {}

        def adam(name: str, value, grad, t: int, speed: float):
            m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
            m = state[name][0] = 0.9 * m + 0.1 * grad
            v = state[name][1] = 0.98 * v + 0.02 * grad * grad
            return value - speed * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-9)

        for t in range(1, steps + 1):
            direction = self.w[:, 1] - self.w[:, 0]
            u = self.e @ direction
            s = np.empty(len(sizes), np.float32)
            for a, b, own in parts:
                s[a:b] = np.add.reduceat(u[flat[own]], ends[a:b] - sizes[a:b] - own.start) / sizes[a:b] + self.b
            p = 1 / (1 + np.exp(-s))
            f = np.bincount(doc, count * p[word], n)
            z = self.scale * f + self.offset + self.length * long_
            q = 1 / (1 + np.exp(-z))
            dz = (q - y) / n
            ds = np.bincount(word, count * (self.scale * dz)[doc], len(p)) * p * (1 - p)
            du, each = np.zeros(BUCKETS), ds / sizes
            for a, b, own in parts:
                du += np.bincount(flat[own], np.repeat(each[a:b], sizes[a:b]), BUCKETS)
            du = du.astype(np.float32)
            ge = du[:, None] * direction + l2 * self.e
            gw = self.e.T @ du
            if log and t % 20 == 0:
                log(t, float(-(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)).mean()), float(self.scale), float(self.offset), float(self.b))
            self.e = adam("e", self.e, ge, t, rate).astype(np.float32)
            self.w = adam("w", self.w, np.stack([-gw, gw], 1) + l2 * self.w, t, rate).astype(np.float32)
            self.b = np.float32(adam("b", np.array([self.b]), np.array([ds.sum()]), t, rate)[0])
            self.scale = np.float32(max(0.1, adam("scale", np.array([self.scale]), np.array([(dz * f).sum()]), t, rate)[0]))
            self.length = np.float32(adam("length", np.array([self.length]), np.array([(dz * long_).sum()]), t, rate)[0])
            self.offset = np.float32(adam("offset", np.array([self.offset]), np.array([dz.sum()]), t, rate)[0])
        return self

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The chance of label 1 of each text."""
        held = [t or "" for t in texts]
        if self.constant is not None:
            return np.full(len(held), self.constant)
        toxic, many = np.zeros(len(held)), np.zeros(len(held))
        part: list[str] = []
        owners: list[int] = []
        size = 0
        for i, t in enumerate([*held, None]):
            if t is None or (part and size + len(t) > STEP):
                self._add(part, owners, toxic, many)
                part, owners, size = [], [], 0
            for piece in cut(t) if t else ():
                if len(t) > STEP:  # piece by piece, so that no text of any length is worked on whole
                    self._add([piece], [i], toxic, many)
                else:
                    part.append(piece)
                    owners.append(i)
                    size += len(piece) + 1
        z = float(self.scale) * toxic + float(self.offset) + float(self.length) * np.log1p(many)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def _add(self, texts: list[str], owners: list[int], toxic: np.ndarray, many: np.ndarray) -> None:
        """Add the texts' expected numbers of toxic words, and of words, to those of their owners."""
        codes, lengths, text = words(texts)
        if not len(lengths):
            return
        u = self.margin if self.e is None else self.e @ (self.w[:, 1] - self.w[:, 0])
        buckets, of = grams(codes, lengths)
        s = np.bincount(of, u[buckets].astype(np.float64), len(lengths)) / np.bincount(of, minlength=len(lengths)) + float(self.b)
        owner = np.array(owners)[text]
        toxic += np.bincount(owner, 1 / (1 + np.exp(-np.clip(s, -500, 500))), len(toxic))
        many += np.bincount(owner, minlength=len(many))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def cut(text: str) -> Iterator[str]:
    """A text in pieces of about ``STEP`` characters, no word cut."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + STEP) if len(text) > at + STEP else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    i = F.col(id_col)
    picked = (
        labels.filter(i.isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(i))
        .select(i.alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    texts = docs.select(i.alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(picked), "_id").orderBy("_id", "_label", F.sha2("_text", 256)).select("_text", "_label").toArrow()
    return Model().fit((t.as_py() for t in rows["_text"]), np.array(rows["_label"].to_pylist(), int))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of every whole text."""
    shared = broadcast_bytes(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select(
        id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their own columns."""
    model = train(docs, labels, id_col, text_col)
    shared = broadcast_bytes(docs.sparkSession, model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(model.scores(texts) < threshold, pa.bool_()))

    return docs.mapInArrow(run, schema)
