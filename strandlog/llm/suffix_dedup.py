"""Removal of passages that occur more than once, by suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere else.

1. Sieve. Winnowing picks anchors: in every string of WIDTH bytes the smallest hash of its
   ``GRAM``-byte grams (the last of equal ones). Equal strings have equal anchors at equal
   places, so a string can only occur again if its anchor does. Each anchor owns the
   starts of the strings it was picked for. Anchors seen once go; nothing else does.
2. The starts an anchor owns fall into two halves by their distance to it. All strings of
   a half share over half their bytes, the core; a half with the bytes its strings need is an
   extract, keyed by its core. Equal extracts are one, with a weight. A core seen once
   goes; where a core has one extract only, its weight tells all there is to know.
   The other extracts meet by core in a shard, so equal strings meet in one shard.
3. Each shard builds a suffix array over its extracts: Larsson-Sadakane refinement in
   numpy, which re-sorts only the groups still unsorted and doubles or triples the prefix each time,
   then Kasai's common prefixes, run in lockstep over all extracts. A start is repeated
   if its common prefix with a neighbour reaches WIDTH or its extract's weight is over one.
4. A shard that outgrows ``SHARD_BYTES`` (a very common passage) is cut into smaller shards
   at random; each pair of these is merged by binary search of the one's suffixes in the
   other's array.

Equal texts are one text with a weight all along. Nothing is collected on the driver. Anchors and cores
that very many rows share are dealt over many tasks wherever they are joined.

Beside the bytes, ``n_passages`` counts the maximal runs of at least ``PASSAGE`` words of a document that occur in
another document too, words compared without the case of A-Z and runs of white space alike. It reports, also
where a passage is shorter than WIDTH, and removes nothing. Winnowing over words sieves first; hashes of all the
strings of ``PASSAGE`` words that the anchors left own are then counted.

Defined results: null counts as empty; texts shorter than WIDTH lose nothing; repeated rows
are equal texts, so each loses all its bytes if it has WIDTH of them; overlapping
occurrences count; matches never cross documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import heavy_keys, land, only_marked, settle, ship, spread_join, unland
from .shingles import _P, _P_INVERSE, _power, mix, words_of

WIDTH = 400
GRAM = 32
#: Words of a passage, at least, and of the grams that sieve passages.
PASSAGE, WORD_GRAM = 51, 12
SHARD_BYTES = 2 << 20
#: Places of a shard up to which a rank takes 21 bits.
RANKS = (1 << 21) - 1
#: Bytes of text that are sieved at once.
CHUNK = 1 << 16


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(raws: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, key, place) of each anchor that owns starts."""
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    k = 0
    while k < len(raws):
        if len(raws[k]) > CHUNK:
            lo, hi, key, place = _long_anchors(raws[k], width)
            out.append((np.full(len(lo), k), lo, hi, key, place))
            k += 1
            continue
        end, size = k, 0
        while end < len(raws) and len(raws[end]) <= CHUNK and (end == k or size + len(raws[end]) <= CHUNK):
            size += len(raws[end])
            end += 1
        lengths = np.array([len(r) for r in raws[k:end]], np.int64)
        ends = np.cumsum(lengths)
        if size >= width:
            lo, hi, key, place = _anchors(np.frombuffer(b"".join(raws[k:end]), np.uint8), width, ends)
            text = np.searchsorted(ends, lo, side="right")
            begin = (ends - lengths)[text]
            out.append((text + k, lo - begin, hi - begin, key, place - begin))
        k = end
    return tuple(np.concatenate([x[i] for x in out]) for i in range(5))


def _long_anchors(raw: bytes, width: int) -> tuple[np.ndarray, ...]:
    n, parts = len(raw), []
    for at in range(0, n - width + 1, CHUNK):
        piece = np.frombuffer(raw, np.uint8)[at : min(n, at + CHUNK + width - 1)]
        parts.append((at, _anchors(piece, width, np.array([len(piece)]))))
    lo, hi, place = (np.concatenate([p[i] + at for at, p in parts]) for i in (0, 1, 3))
    key = np.concatenate([p[2] for _, p in parts])
    first = np.flatnonzero(np.diff(place, prepend=-1))  # an anchor may own starts on both sides of a cut
    return lo[first], np.append(hi[first[1:] - 1], hi[-1]), key[first], place[first]


def _anchors(b: np.ndarray, width: int, ends: np.ndarray):
    """Anchors of texts laid end to end; strings across two texts are left out."""
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CASED[b] * _power(_P, n), out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * _power(_P_INVERSE, n + 1)[: n - GRAM + 1])
    span = width - GRAM + 1
    chosen = _smallest(h, span)
    inside = np.ones(len(chosen) + width, bool)
    for e in ends.tolist():
        inside[max(0, e - width + 1) : e] = False
    starts = np.flatnonzero(inside[: len(chosen)])
    chosen = chosen[starts]
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(new[1:], len(chosen)) - 1 if len(new) else new
    return starts[new], starts[last], h[chosen[new]], chosen[new]


_BYTE_CASED = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _smallest(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest hash (the last of equal upper halves) of every ``span`` in a row."""
    place = np.arange(len(h), dtype=np.uint64)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    size = 1
    while 2 * size <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < span:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    return (np.uint64(0xFFFFFFFF) - (m & np.uint64(0xFFFFFFFF))).astype(np.int64)


class _Words:
    """The words of some texts as hashes, and hashes of words in a row."""

    def __init__(self, raws: list[bytes]):
        self.w, counts = words_of(raws)
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.total = np.zeros(len(self.w) + 1, np.uint64)
        np.cumsum(self.w * _power(_P, len(self.w)), out=self.total[1:])

    def sums(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A hash of the words from lo to before hi."""
        return mix((self.total[hi] - self.total[lo]) * _power(_P_INVERSE, len(self.w) + 1)[lo] + (hi - lo).astype(np.uint64))

    def anchors(self, k: int) -> tuple[np.ndarray, ...]:
        """(text, first start, last start, key, hash of all its words) of each anchor, places from the text's start."""
        n = len(self.w)
        if n < k:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        at = np.arange(n - WORD_GRAM + 1)
        h = self.sums(at, at + WORD_GRAM)
        chosen = _smallest(h, k - WORD_GRAM + 1)
        text = np.searchsorted(self.ends, np.arange(len(chosen)), side="right")
        starts = np.flatnonzero(np.arange(len(chosen)) + k <= self.ends[text])  # not across two texts
        chosen = chosen[starts]
        new = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(new[1:], len(chosen)) - 1 if len(new) else new
        lo, hi = starts[new], starts[last]
        of = text[lo]
        return of, lo - self.begins[of], hi - self.begins[of], h[chosen[new]], self.sums(lo, hi + k)


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about ``CHUNK`` bytes of text, and the texts."""
    for batch in batches:
        at, size, raws = 0, 0, []
        for i, t in enumerate(batch.column(column)):
            raws.append(_raw(t.as_py()))
            size += len(raws[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                yield batch.slice(at, len(raws)), raws
                at, size, raws = i + 1, 0, []


def passages(rows: DataFrame, copies: DataFrame, k: int = PASSAGE) -> DataFrame:
    """(_t, _passages): texts with runs of at least ``k`` words that another document holds too.

    ``rows`` has _k, _t (hash of the text) and _text, ``copies`` _t, _times and the _k of a row with that text.
    Anchors that several texts share are kept. Where all the texts have the same words around one, all strings it
    owns are shared; only the others are told apart string by string.
    """

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in _by_bytes(batches, 1):
            of, lo, hi, key, whole = _Words(raws).anchors(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64))],
                ["_t", "_lo", "_hi", "_key", "_all"],
            )

    found = land(rows.select("_t", "_text").mapInArrow(sieve, "_t long, _lo int, _hi int, _key long, _all long"), "word-anchors")
    counts = found.groupBy("_key").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.min("_all").alias("_c"), F.max("_all").alias("_e"), F.count(F.lit(1)).alias("_rows"))
    again = land(counts.filter("_a <> _b").select("_key", (F.col("_c") == F.col("_e")).alias("_same"), "_rows"), "word-keys")
    held = land(spread_join(found.drop("_all"), again.drop("_rows"), ["_key"], heavy_keys(again.drop("_same")), by=["_t", "_lo"]).select("_t", "_lo", "_hi", "_same"), "word-sites")
    # a text that occurs several times is one run throughout
    long = land(found.select("_t").distinct().join(copies.filter("_times > 1").select("_t"), "_t"), "word-copies")
    unland(found)
    own = held.filter(~F.col("_same")).groupBy("_t").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_own"))
    asked = land(own.join(copies, "_t").select("_k", "_t", "_own"), "word-asked")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in _by_bytes(batches, 2):
            held = _Words(raws)
            of, at = [], []
            for i, own in enumerate(batch.column(1)):
                at.append(np.unique(np.concatenate([np.arange(x["_lo"], x["_hi"] + 1) for x in own.as_py()])))
                of.append(np.full(len(at[-1]), i))
            of, at = np.concatenate(of), np.concatenate(at)
            h = held.sums(held.begins[of] + at, held.begins[of] + at + k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], ["_t", "_lo", "_h"])

    texts = only_marked(rows, asked, "_t").join(asked, ["_k", "_t"]).dropDuplicates(["_t"]).select("_t", "_own", "_text")
    seen = land(texts.mapInArrow(strings, "_t long, _lo int, _h long"), "word-strings")
    twice = seen.groupBy("_h").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.lit(1)).alias("_rows")).filter("_a <> _b").select("_h", "_rows")
    twice = land(twice, "word-strings-again")
    shared = spread_join(seen, twice.select("_h"), ["_h"], heavy_keys(twice), "left_semi", ["_t", "_lo"])
    runs_ = shared.select("_t", "_lo", F.col("_lo").alias("_hi")).unionByName(held.filter("_same").select("_t", "_lo", "_hi"))
    single = runs_.join(copies.filter("_times = 1").select("_t"), "_t").groupBy("_t").agg(F.sort_array(F.collect_set(F.struct("_lo", "_hi"))).alias("_runs"))
    step = lambda acc, x: F.struct((acc["n"] + F.when(x["_lo"] > acc["last"] + k, 1).otherwise(0)).alias("n"), F.greatest(acc["last"], x["_hi"]).alias("last"))
    many = F.aggregate("_runs", F.struct(F.lit(0).alias("n"), F.lit(-k - 1).alias("last")), step)["n"].cast("long")
    told = land(single.select("_t", many.alias("_passages")).unionByName(long.select("_t", F.lit(1).cast("long").alias("_passages"))), "passages")
    unland(held, long, again, asked, seen, twice)
    return told


def halves(lo: int, hi: int, p: int, width: int) -> list[tuple[int, int, tuple[int, int]]]:
    """The starts lo..hi of the anchor at p as (first, last, core) of each half.

    Strings of the left half start at least ``far`` before the anchor, so they all hold the
    bytes from p - far to its end; the others hold those from p to where the first of
    them ends.
    """
    far = (width - GRAM) // 2 + 1
    cut = p - far
    out = []
    if lo <= cut:
        out.append((lo, min(hi, cut), (cut, p + GRAM)))
    if hi > cut:
        out.append((max(lo, cut + 1), hi, (p, cut + 1 + width)))
    return out


class Shard:
    """A suffix array over some byte strings, sorted as far as the first ``width`` bytes.

    Only starts with ``width`` bytes after them in their string are listed in ``order``.
    """

    def __init__(self, strings: list[bytes], width: int = WIDTH):
        self.width = width
        self.text = np.frombuffer(b"".join(strings) + bytes(width + 16), np.uint8)
        lengths = np.array([len(s) for s in strings], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.end = self.begin + lengths
        self.n = int(lengths.sum())
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), lengths)
        self._refine()

    def word(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, big end first."""
        return np.ndarray((self.n + self.width + 8,), ">u8", self.text.data, 0, (1,))[at].astype(np.uint64)

    def _refine(self) -> None:
        n = self.n
        if not n:
            self.order = np.zeros(0, np.int64)
            return
        stop = self.end[self.owner].astype(np.int32)
        at = np.arange(n, dtype=np.int32)
        key = self.word(at)
        short = np.flatnonzero(stop - at < 8)  # bytes of the next string do not count
        key[short] &= ~np.uint64(0) << ((8 - (stop[short] - at[short])).astype(np.uint64) * np.uint64(8))
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(fresh).astype(np.int32)[np.cumsum(fresh) - 1]
        alone = fresh & np.append(fresh[1:], True)
        active = order[~alone]  # places of groups not sorted yet, group by group
        # two ranks fit a key, three where a rank takes 21 bits: the sorted prefix grows so many times a round
        steps, bits = (3, np.uint64(21)) if n < RANKS else (2, np.uint64(32))
        h = 8
        while h < self.width and len(active):
            key, end = rank[active].astype(np.uint64), stop[active]
            for k in range(1, steps):  # the ranks h, 2h, ... ahead; 0 behind the string's end
                ahead = active + np.int32(k * h)
                key = (key << bits) | np.where(ahead < end, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
            perm = np.argsort(key)
            active, key = active[perm], key[perm]
            base = (key >> (bits * np.uint64(steps - 1))).astype(np.int32)
            index = np.arange(len(active), dtype=np.int32)
            group = np.concatenate([[True], base[1:] != base[:-1]])
            sub = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(group, index, 0))
            substart = np.maximum.accumulate(np.where(sub, index, 0))
            rank[active] = base + substart - start
            active = active[~(sub & np.append(sub[1:], True))]
            h *= steps
        places = np.flatnonzero(stop - np.arange(n) >= self.width)
        self.order = places[np.argsort(rank[places], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, other: Shard | None = None) -> np.ndarray:
        """Length of the common prefix, up to ``width``, of the suffixes at a and b."""
        other = other or self
        got = known.copy()
        open_ = np.flatnonzero(got < self.width)
        while len(open_):
            g = got[open_]
            x, y = self.word(a[open_] + g), other.word(b[open_] + g)
            differ = x != y
            # equal leading bytes of two words: from the highest bit that differs
            z = x[differ] ^ y[differ]
            lead = np.zeros(len(z), np.int64)
            for bits in (32, 16, 8):
                high = z < (np.uint64(1) << np.uint64(64 - bits))
                lead[high] += bits
                z = np.where(high, z << np.uint64(bits), z)
            got[open_[differ]] += lead // 8
            open_ = open_[~differ]
            got[open_] += 8
            open_ = open_[got[open_] < self.width]
        return np.minimum(got, self.width)

    def repeated(self) -> np.ndarray:
        """Starts whose common prefix with a neighbour in the array reaches ``width``.

        Kasai's rule: the common prefix of the next start is at most one shorter, as long
        as the start after the neighbour comes before it in the array too. All strings
        advance together, one start each at a time.
        """
        m = len(self.order)
        if m < 2:
            return np.zeros(0, np.int64)
        at = np.full(self.n, -1, np.int64)
        at[self.order] = np.arange(m)
        lcp = np.zeros(m, np.int64)  # with the suffix before it
        counts = np.maximum(0, self.end - self.begin - self.width + 1)
        live = np.flatnonzero(counts > 0)
        live = live[np.argsort(-counts[live], kind="stable")]
        known, beside = np.zeros(len(live), np.int64), np.full(len(live), -1, np.int64)
        steps = int(counts.max(initial=0))
        sizes = counts[live]
        for k in range(steps):
            keep = int(np.searchsorted(-sizes, -k, side="left"))  # strings with more than k starts
            live, sizes, known, beside = live[:keep], sizes[:keep], known[:keep], beside[:keep]
            place = self.begin[live] + k
            pos = at[place]
            after = np.minimum(beside + 1, self.n - 1)
            holds = (beside >= 0) & (self.owner[after] == self.owner[beside]) & (at[after] >= 0) & (at[after] < pos)
            has = pos > 0
            got = np.zeros(len(live), np.int64)
            if has.any():
                got[has] = self.common(place[has], self.order[pos[has] - 1], np.where(holds, np.maximum(0, known - 1), 0)[has])
            lcp[pos] = got
            known, beside = got, np.where(has, self.order[pos - 1], -1)
        same = lcp >= self.width
        return np.sort(self.order[same | np.append(same[1:], False)])

    def find(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(own starts, other's starts) that occur in both, by binary search of the
        other's suffixes in this array."""
        q = other.order
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.order), np.int64)
        zero = np.zeros(len(q), np.int64)
        while len(self.order):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            mine = self.order[mid]
            c = self.common(mine, q[open_], zero[open_], other)
            less = (c < self.width) & (self.text[mine + np.minimum(c, self.width - 1)] < other.text[q[open_] + np.minimum(c, self.width - 1)])
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        hit = np.flatnonzero(lo < len(self.order))
        hit = hit[self.common(self.order[lo[hit]], q[hit], zero[hit], other) >= self.width] if len(hit) else hit
        first = np.unique(lo[hit])
        own = []
        while len(first):  # all of this array's suffixes equal to one found
            own.append(self.order[first])
            nxt = first[first + 1 < len(self.order)]
            first = nxt[self.common(self.order[nxt], self.order[nxt + 1], np.zeros(len(nxt), np.int64)) >= self.width] + 1 if len(nxt) else nxt
        return (np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)), q[hit]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted places as (first, last) runs."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def _shard_runs(group: pa.Table, width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Rows of a shard's table with their repeated starts as runs."""
    own = group.column("_own").to_numpy()
    strings = group.column("_extract").to_pylist()
    weight = group.column("_weight").to_numpy()
    i, j = (group.column(c)[0].as_py() for c in ("_i", "_j"))
    out: dict[int, np.ndarray] = {}

    def note(shard: Shard, rows: np.ndarray, places: np.ndarray) -> None:
        owner = shard.owner[places]
        for k in np.unique(owner):
            out[int(rows[k])] = places[owner == k] - shard.begin[k]

    if i == j:
        rows = np.arange(len(strings))
        shard = Shard(strings, width)
        note(shard, rows, shard.repeated())
        for r in np.flatnonzero(weight > 1).tolist():
            out[r] = np.arange(len(strings[r]) - width + 1)
    else:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = Shard([strings[r] for r in left], width), Shard([strings[r] for r in right], width)
        x, y = a.find(b)
        note(a, left, np.sort(x))
        note(b, right, np.sort(y))
    return [(r, runs(p)) for r, p in sorted(out.items()) if len(p)]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: id, n_bytes, text_sha256, spans, kept, n_passages.

    ``spans`` are the maximal runs removed, as byte offsets (start, end exclusive);
    ``kept`` holds the remaining bytes where something was removed, else null.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    name = F.substring(F.unhex(sha), 1, 16)
    # ids as text, so that a null id finds its row and one partitioning serves the join and what follows
    id_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(id_text(F.col(id_col)).alias("_k"), name.alias("_d"), text.alias("_text"))
    at = F.xxhash64("_d").alias("_t")
    base = land(docs.select(F.col(id_col).alias("_id"), name.alias("_d"), F.octet_length(text).cast("long").alias("_n"), sha.alias("_sha")), "texts")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, lo, hi, key, place = anchors([_raw(t) for t in batch.column(1).to_pylist()], width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (lo, hi, place)), pa.array(key.view(np.int64))],
                ["_d", "_lo", "_hi", "_p", "_key"],
            )

    copies = land(base.groupBy("_d").agg(F.count(F.lit(1)).alias("_times"), F.min("_id").alias("_rep")).select("_d", "_times", id_text(F.col("_rep")).alias("_k")), "text-counts")
    shared = passages(rows.select("_k", at, "_text"), copies.select(at, "_times", "_k"))
    settle(spark)
    found = land(rows.select("_d", "_text").mapInArrow(sieve, "_d binary, _lo int, _hi int, _p int, _key long"), "anchors")
    site = F.xxhash64("_d", "_lo")
    again = found.groupBy("_key").agg(F.min(site).alias("_a"), F.max(site).alias("_b"), F.count(F.lit(1)).alias("_rows")).filter("_a <> _b").select("_key", "_rows")
    again = land(again, "anchor-keys")
    lists = spread_join(found, again.select("_key"), ["_key"], heavy_keys(again), "left_semi", ["_d", "_lo"]).groupBy("_d").agg(F.collect_set(F.struct("_lo", "_hi", "_p")).alias("_own"))
    wanted = land(lists.join(copies, "_d").select("_k", "_d", "_times", "_own"), "wanted")
    suspects = land(only_marked(rows, wanted, "_d").join(wanted, ["_k", "_d"]).dropDuplicates(["_k", "_d"]).select("_d", "_times", "_own", "_text"), "suspects")

    unland(found)

    def name_extracts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, lo, hi, key, name = [], [], [], [], []
            for k, (own, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                raw = _raw(t)
                for x in own:
                    for a, b, core in halves(x["_lo"], x["_hi"], x["_p"], width):
                        side = b"L" if core[0] < x["_p"] else b"R"
                        of.append(k)
                        lo.append(a)
                        hi.append(b)
                        key.append(hashlib.blake2b(raw[core[0] : core[1]], digest_size=8, salt=side).digest())
                        name.append(hashlib.blake2b(raw[a : b + width], digest_size=16).digest())
            of = pa.array(of, pa.int32())
            keys = pa.array(np.frombuffer(b"".join(key), np.int64) if key else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), keys, pa.array(name, pa.binary())],
                ["_d", "_times", "_lo", "_hi", "_key", "_e"],
            )

    named = land(suspects.mapInArrow(name_extracts, "_d binary, _times long, _lo int, _hi int, _key long, _e binary"), "extract-sites")
    e = F.xxhash64("_e")
    cores = named.groupBy("_key").agg(F.sum("_times").alias("_all"), F.min(e).alias("_a"), F.max(e).alias("_b"), F.count(F.lit(1)).alias("_rows")).filter("_all > 1")
    cores = land(cores.select("_key", "_rows", (F.col("_a") == F.col("_b")).alias("_alone")), "core-keys")
    heavy = heavy_keys(cores.select("_key", "_rows"))
    sited = land(spread_join(named, cores.drop("_rows"), ["_key"], heavy, by=["_d", "_lo"]), "cored-sites")
    unland(named)
    sites = sited.filter(~F.col("_alone")).drop("_alone")
    extracts = sites.groupBy("_key", "_e").agg(F.sum("_times").alias("_weight"), F.min(F.struct("_d", "_lo", "_hi")).alias("_at"))
    picked = extracts.groupBy(F.col("_at._d").alias("_d")).agg(F.collect_list(F.struct("_key", "_e", "_weight", F.col("_at._lo").alias("_lo"), F.col("_at._hi").alias("_hi"))).alias("_take"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists_, t in zip(batch.column(0), batch.column(1)):
                raw, take = _raw(t.as_py()), lists_.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in take], k) for c, k in (("_key", pa.int64()), ("_e", pa.binary()), ("_weight", pa.int64()))]
                    + [pa.array([raw[x["_lo"] : x["_hi"] + width] for x in take], pa.binary())],
                    ["_key", "_e", "_weight", "_extract"],
                )

    pool = land(suspects.select("_d", "_text").join(picked, "_d").select("_take", "_text").mapInArrow(cut_out, "_key long, _e binary, _weight long, _extract binary"), "extracts")
    size = pool.agg(F.sum(F.octet_length("_extract"))).first()[0] or 0
    shards = max(1, -(-2 * size // SHARD_BYTES))
    dealt = pool.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("long"))
    blocks = dealt.groupBy("_shard").agg(F.ceil(F.sum(F.octet_length("_extract")) / SHARD_BYTES).cast("int").alias("_blocks"))
    placed = (
        dealt.join(blocks, "_shard")
        .withColumn("_own", F.pmod(F.xxhash64("_e", "_key"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("_shard", "_key", "_e", "_weight", "_extract", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    )

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        told = _shard_runs(group, width)
        at = pa.array([r for r, _ in told], pa.int64())
        flat = [[{"a": a, "b": b} for a, b in x] for _, x in told]
        return pa.table({"_key": group.column("_key").take(at), "_e": group.column("_e").take(at), "_runs": pa.array(flat, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))})

    told = land(placed.groupBy("_shard", "_i", "_j").applyInArrow(work, "_key long, _e binary, _runs array<struct<a: long, b: long>>"), "repeats")
    often = land(sites.groupBy("_key", "_e").agg(F.count(F.lit(1)).alias("_rows")), "extract-counts")
    spots = spread_join(sites, told, ["_key", "_e"], heavy_keys(often), by=["_d", "_lo"]).select("_d", F.transform("_runs", lambda r: F.struct((r["a"] + F.col("_lo")).alias("a"), (r["b"] + F.col("_lo") + width).alias("b"))).alias("_runs"))
    full = F.array(F.struct(F.col("_lo").cast("long").alias("a"), (F.col("_hi") + width).cast("long").alias("b")))
    spots = spots.unionByName(sited.filter("_alone").select("_d", full.alias("_runs")))
    covered = spots.groupBy("_d").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, kept = [], []
            for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, merged = _raw(t), []
                for a, b in sorted((x["a"], x["b"]) for x in r):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in merged])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(kept, pa.binary())], ["_d", "_spans", "_kept"])

    single = suspects.filter("_times = 1").select("_d", "_text").join(covered, "_d")
    cuts = single.mapInArrow(cut, "_d binary, _spans array<struct<start: long, end: long>>, _kept binary")
    whole = base.filter(F.col("_n") >= width).groupBy("_d", "_n").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select(
        "_d", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_n").alias("end"))).alias("_spans"), F.lit(b"").cast("binary").alias("_kept")
    )
    told = cuts.unionByName(whole).join(copies.select("_d", at).join(shared, "_t").drop("_t"), "_d", "full")
    heavy = heavy_keys(copies.select("_d", F.col("_times").alias("_rows")))
    return spread_join(base, told, ["_d"], heavy, "left", ["_id"]).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_bytes"), F.col("_sha").alias("text_sha256"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"),
        F.coalesce("_passages", F.lit(0)).cast("long").alias("n_passages"),
    )
