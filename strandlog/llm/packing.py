"""Best-fit packing by minimum bin slack.

Texts become token ids plus an end-of-document id. Only documents longer than a sequence
are cut, into full pieces after a first piece that takes the remainder. What is left is a
histogram: how many pieces there are of each length. It has at most ``capacity`` entries
whatever the corpus holds, so the driver packs the histogram, never the pieces.

Per bin, the longest length left is set, and a bitset subset-sum over the lengths
available finds the fullest combination that fits beside it; the combination is then
removed, as many times over as the histogram allows. Each such plan line uses a length up to
below what one more repetition needs, so the plan has a number of lines bounded by the capacity too.

Pieces then get a rank among those of their length, counted in salted shares so that one
length that a third of all pieces have is not one task's work, and the plan turns (length,
rank) into sequence and offset by arithmetic.

Defined results: null and empty texts are one piece of the end id alone; repeated ids and
texts are packed each for itself; strings of added tokens in a text are those tokens, as the
tokenizers library has it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import land, ship, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Shares a length's pieces are ranked in, at least.
SALTS = 64
#: Rows that are worked on at once.
SLICE = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by rule: visible Latin-1
    characters stand for themselves, all other bytes for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks by bytes, ids of added tokens) of a byte-level vocabulary file in JSON.

    Its ids follow the order of its merges, so an id is a rank as well.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    back = byte_alphabet()
    return {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}, added


class Tokens:
    """Ids of a text by the vocabulary, as unsigned 32-bit integers.

    The merge loop is tiktoken's over the same vocabulary, several times faster than the tokenizers
    library and equal to it id by id (tests compare them). A text that holds the string of an added
    token, or on which the pattern engine gives up, goes through the tokenizers library.
    """

    def __init__(self, path: str):
        self.path = path
        self._fast = self._slow = None
        self._added: list[str] = []

    def __getstate__(self):
        return {"path": self.path, "_fast": None, "_slow": None, "_added": []}

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None:
            import tiktoken

            from .bpe import PATTERN

            ranks, added = ranks_of(self.path)
            self._added = list(added)
            self._fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if not any(a in text for a in self._added):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the engine's panic is no Exception
                if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                    raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


_tokens: dict[str, Tokens] = {}

PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if kept, the ids."""
    ship(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    schema = T.StructType([id_field, *(PIECES.fields if keep_ids else PIECES.fields[:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokens.setdefault(path, Tokens(path))
        end = np.array([end_id], "<u4")
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                x = np.concatenate([tok.ids(text or "").astype("<u4"), end])
                at, cut = 0, (len(x) - 1) % capacity + 1
                k = 0
                while at < len(x):
                    raw = x[at:cut].tobytes()
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(cut - at)
                    crc.append(zlib.crc32(raw))
                    if keep_ids:
                        ids.append(raw)
                    at, cut, k = cut, cut + capacity, k + 1
            cols = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if keep_ids else []), [f.name for f in schema.fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def fullest(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The combination with the largest sum up to ``room``: {length: copies}.

    ``lengths`` is (length, copies left), longest first. Bit s of a bitset says that sum s
    can be reached; counts enter by powers of two. Reading the kept bitsets backwards
    gives the combination.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, left in lengths:
        if length > room:
            continue
        left = min(left, room // length)
        k = 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            best -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Plan lines (repetitions, {length: copies per sequence}) that use the histogram up."""
    left = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        seed = order[0]
        left[seed] -= 1
        combo = fullest([(x, left[x]) for x in order if left[x] > 0], capacity - seed)
        left[seed] += 1
        combo[seed] = combo.get(seed, 0) + 1
        times = min(left[x] // c for x, c in combo.items())
        for x, c in combo.items():
            left[x] -= c * times
        out.append((times, combo))
        order = [x for x in order if left[x] > 0]
    return out


def plan_rows(lines: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, copies, first offset) per line and length."""
    rows, used, base = [], {}, 0
    for times, combo in lines:
        offset = 0
        for length, copies in sorted(combo.items(), reverse=True):
            at = used.get(length, 0)
            rows.append((length, at, at + times * copies, base, copies, offset))
            used[length] = at + times * copies
            offset += length * copies
        base += times
    return rows


def ranked(rows: DataFrame, key: str, tie: list[str], salts: int) -> DataFrame:
    """``rows`` with ``_rank`` from 0 among those of equal ``key``.

    Ranks count within (key, salt) and start at the rows of the smaller salts, so the work on
    one key spreads over ``salts`` groups.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)).cast("int"))
    shares = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_share"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select(key, "_salt", F.coalesce(F.sum("_share").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy(key, "_salt").orderBy(*tie)
    return (
        salted.withColumn("_within", F.row_number().over(within) - 1)
        .join(starts, [key, "_salt"])
        .withColumn("_rank", F.col("_from") + F.col("_within"))
        .drop("_salt", "_from", "_within")
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces with their place: id, piece, start, length, ids_crc32, ids?, sequence_id, offset."""
    spark = docs.sparkSession
    cut = land(pieces(docs, id_col, text_col, capacity, end_id, path, keep_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    lines = plan(counts, capacity)
    rows = plan_rows(lines)
    table = spark.createDataFrame(rows, "_length long, _lo long, _hi long, _base long, _copies int, _first long")
    salts = max(SALTS, sum(counts.values()) // 20_000)
    placed = ranked(cut, "length", [id_col, "piece"], salts)
    at = F.col("_rank") - F.col("_lo")
    return placed.join(
        F.broadcast(table),  # plan lines: bounded by the capacity
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
    ).select(
        *[F.col(c) for c in cut.columns],
        (F.col("_base") + F.floor(at / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_first") + F.pmod(at, F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )
