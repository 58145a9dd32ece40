"""Byte-level BPE by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a
vocabulary entry resolves with one probe and one comparison of bytes. Tier two serves
the misses: the bytes of the pre-token are a doubly linked list, candidate merges wait in
a heap ordered by (rank, position), and stale entries are skipped when they surface.

Both tables are built once on the driver from a rank file, whose size bounds them, and
broadcast. Workers keep a bounded memo of resolved pre-tokens, emptied when full.

Defined results: null text counts as empty and encodes to no ids; texts are never cut;
special tokens are not recognised, their strings are ordinary text; extra columns ride along.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import broadcast_bytes, fresh, tokenizer_path

#: Pre-token pattern of the public byte-level vocabularies; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Resolved pre-tokens a worker remembers.
MEMO = 400_000
#: Rows that are worked on at once.
SLICE = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash: n keys to n slots by hash and displace.

    Keys fall into buckets by one half of their hash. Buckets, largest first, look for a
    displacement that sends all their keys to free slots; a bucket of one key takes a free
    slot directly, stored as its negative.
    """

    def __init__(self, ranks: dict[bytes, int], load: int = 4):
        keys = list(ranks)
        self.n = n = len(keys)
        self.r = max(1, n // load)
        self.keys: list[bytes | None] = [None] * n
        self.values = np.zeros(n, np.uint32)
        self.shift = [0] * self.r
        buckets: dict[int, list[bytes]] = {}
        hashes = {k: xxhash.xxh3_64_intdigest(k) for k in keys}
        for k, h in hashes.items():
            buckets.setdefault((h >> 32) % self.r, []).append(k)
        free = np.ones(n, bool)
        singles = []
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            hs = [hashes[k] for k in members]
            d = 1
            while True:
                slots = [self.spread(h, d) for h in hs]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for k, s in zip(members, slots):
                free[s] = False
                self.keys[s], self.values[s] = k, ranks[k]
        for (b, k), s in zip(singles, np.flatnonzero(free).tolist()):
            self.shift[b] = -s - 1
            self.keys[s], self.values[s] = k, ranks[k]

    def spread(self, h: int, d: int) -> int:
        return (((h & 0xFFFFFFFF) * (2 * d + 1) + d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 7) % self.n

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.r]
        s = -d - 1 if d < 0 else self.spread(h, d)
        return int(self.values[s]) if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: lowest rank first, leftmost among equals."""
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next part
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j] = False
        end[i] = e
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get(piece[i : end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:e])
            if r is not None:
                heapq.heappush(heap, (r, h, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.hash, self.pattern = ranks, PerfectHash(ranks), pattern
        self.memo: dict[str, bytes] = {}
        self._bytes: list[bytes] | None = None
        self._find = None

    def __getstate__(self):
        return {"ranks": self.ranks, "hash": self.hash, "pattern": self.pattern, "memo": {}, "_bytes": None, "_find": None}

    def resolve(self, token: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        raw = token.encode("utf-8")
        rank = self.hash.get(raw)
        ids = [rank] if rank >= 0 else merge(raw, self.ranks)
        out = np.array(ids, "<u4").tobytes()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(token) <= 64:
            self.memo[token] = out
        return out

    def encode(self, text: str) -> bytes:
        if self._find is None:
            self._find = regex.compile(self.pattern).findall
        get, resolve = self.memo.get, self.resolve
        return b"".join([get(t) or resolve(t) for t in self._find(text)])

    def decode(self, ids: bytes) -> bytes:
        if self._bytes is None:
            table = [b""] * (max(self.ranks.values(), default=-1) + 1)
            for k, v in self.ranks.items():
                table[v] = k
            self._bytes = table
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


class _Shared:
    """A broadcast codec and the key of a worker's one copy of it."""

    def __init__(self, codec, key: str):
        self.codec, self.key = codec, key

    def get(self) -> Codec:
        if self.key not in _codecs:
            _codecs.clear()
            _codecs[self.key] = self.codec.value
        return _codecs[self.key]


def shared_codec(df: DataFrame, path: str | None = None) -> _Shared:
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    return _Shared(broadcast_bytes(df.sparkSession, Codec(read_ranks(path))), uuid.uuid4().hex)


def _mapped(df: DataFrame, source: str, target: str, f) -> DataFrame:
    """``df`` with the binary column ``target`` = f(column ``source``), batch by batch."""
    schema = T.StructType([x for x in df.schema.fields if x.name not in (source, target)] + [T.StructField(target, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = f()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                done = pa.array([call(x) for x in batch.column(batch.schema.get_field_index(source)).to_pylist()], pa.binary())
                names = [x.name for x in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), done], [*names, target])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, shared: _Shared | None = None) -> DataFrame:
    """``df`` with the text column replaced by its ids, little-endian unsigned 32-bit."""
    shared = shared or shared_codec(df, path)
    return _mapped(df, text_col, ids_col, lambda: (lambda x, e=shared.get().encode: e(x or "")))


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "bytes", path: str | None = None, shared: _Shared | None = None, keep_ids: bool = True) -> DataFrame:
    """``df`` with the bytes of its ids; null ids decode to no bytes."""
    shared = shared or shared_codec(df, path)
    source = fresh("_ids", df)
    held = df.withColumn(source, F.col(ids_col)) if keep_ids else df.withColumnRenamed(ids_col, source)
    return _mapped(held, source, bytes_col, lambda: (lambda x, d=shared.get().decode: d(x or b"")))
