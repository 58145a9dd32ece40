"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base. Emails, IPv4 addresses, payment cards and phone numbers are the leftmost
non-overlapping matches of a pattern per kind, kept if they pass its check.

Bootstrap. Tokens of identifier shape (they hold a digit or an at sign) are instances; those
that touch a base span are seeds of its kind, and hexadecimal strings of at least 32 digits are seeds
of a fifth kind, ``secret``, which only context can make a span. The words around instances induce lexical
patterns (two words to the left; one to each side; words are read from the last 96 characters before an
instance and the first 48 after it). Patterns and instances form a graph
on which scores move to and fro: a pattern's confidence in a kind is the score of that
kind among the distinct values it meets, over the scores of all kinds and the values known to be no
identifiers (under six characters, or with fewer than two digits and no at sign); values that nothing is known of are neutral,
but at least half of all values must speak for the kind, and enough distinct seeds. A value's score is the
noisy-or of its patterns. Values above the bar act as soft seeds of the next round. In the end,
instances that no base span touches, whose value and one of whose patterns are above the
bar, are added as spans of the pattern's kind. An instance right after another one has no words to its left.

Patterns are possessive and anchored where that leaves the matches as they are, so long
runs cost linear time and no stack. Offsets are in code points, ends exclusive.

Defined results: null counts as empty and has no spans; repeated rows are reported row
by row and count as one value in the graph; an empty table gives no rows; other columns
ride along untouched in ``redact`` and are ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fresh, land, row_key

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only context finds, by the shape of their seeds.
SHAPES = {"secret": r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$"}
ALL_KINDS = (*KINDS, *SHAPES)
#: The patterns of the contract, written so that Java's engine needs no backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to match at all.
NEEDS = {"email": "@", "phone": "+"}
MATCH = "array<struct<o:int,g:int,m:string,tail:string,head:string>>"
#: A run of non-white characters that holds a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A pattern counts from so many distinct seed values on.
SUPPORT = 5
#: Confidence from which patterns and values act.
BAR = 0.8
#: Share of a pattern's values that must speak for its kind.
KNOWN = 0.5
ROUNDS = 3
#: Up to so many spans a text is cut by offsets, beyond by its characters, as a cut by offset counts from the start.
FEW = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    double = lambda i: F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when(i % 2 == 0, double(i)).otherwise(value(i)))
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern stands."""
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        n = F.length(_digits(m))
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _gaps(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def _paired(order: int, none: Column):
    return lambda g, m: F.struct(F.lit(order).alias("o"), F.length(g).alias("g"), m.alias("m"), none.alias("tail"), none.alias("head"))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_at, _id, _h, w): the matches of each text with the gaps before them, and for tokens the
    words around. Landed, so that no text travels on; ``_at`` is the landed row's place."""
    # without a digit or an at sign nothing can match; that pass is far cheaper than the patterns
    told = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col)).otherwise("").alias("_text"))
    text = F.col("_text")
    none = F.lit(None).cast("string")
    parts = []
    for o, kind in enumerate(KINDS):
        p = PATTERNS[kind]
        pairs = F.zip_with(_gaps(text, p), _all(text, p), _paired(o, none))
        parts.append(F.when(text.contains(NEEDS[kind]), pairs).otherwise(F.array().cast(MATCH)) if kind in NEEDS else pairs)
    around = F.transform(
        _gaps(text, TOKEN),
        lambda x: F.struct(
            F.length(x).alias("n"),
            F.regexp_extract(F.right(x, F.lit(96)), r"(\S+\s+)?(\S+)\s*$", 0).alias("tail"),
            F.regexp_extract(F.left(x, F.lit(48)), r"^\s*(\S+)", 1).alias("head"),
        ),
    )
    tokens = F.zip_with(
        around, _all(text, TOKEN),
        lambda x, m: F.struct(F.lit(len(KINDS)).alias("o"), x["n"].alias("g"), m.alias("m"), x["tail"].alias("tail"), x["head"].alias("head")),
    )
    found = F.filter(F.flatten(F.array(*parts, tokens)), lambda x: x["m"].isNotNull() | (x["o"] == len(KINDS)))
    landed = land(told.select("_id", "_h", found.alias("w")), "pii-scan")
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return landed.select(at.alias("_at"), "*")


def matches(scanned: DataFrame) -> DataFrame:
    """One row per match: _at, _id, o (place of its kind), n, s, e, m, left and right context.

    Starts are running sums over a text's gaps and matches.
    """
    rows = scanned.select("_at", "_id", F.posexplode("w").alias("i", "x")).select("_at", "_id", "i", "x.*")
    order = Window.partitionBy("_at", "o").orderBy("i")
    width = F.col("g") + F.coalesce(F.length("m"), F.lit(0))
    return (
        rows.withColumn("e", F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .withColumn("right", F.when(F.col("o") == len(KINDS), F.lead("head").over(order)))
        .withColumn("n", F.row_number().over(order) - 1)
        .filter(F.col("m").isNotNull())
        .select("_at", "_id", "o", "n", (F.col("e") - F.length("m")).alias("s"), "e", "m", F.col("tail").alias("left"), "right")
    )


def base_of(found: DataFrame) -> DataFrame:
    """The matches that are base spans."""
    ok = F.lit(False)
    for o, kind in enumerate(KINDS):
        ok = F.when(F.col("o") == o, passes(kind, F.col("m"))).otherwise(ok)
    return found.filter((F.col("o") < len(KINDS)) & ok)


def instances(found: DataFrame, base: DataFrame) -> DataFrame:
    """One row per token: place, index, value, span, seed kind or null, whether a base span touches it,
    whether it is known to be no identifier, patterns.

    A token is a base seed if the base spans that start before its end reach beyond its start;
    a running maximum over the text tells.
    """
    none = F.lit(None).cast("string")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("o") + 1)
    spans = base.select("_at", "_id", F.lit(None).cast("int").alias("n"), "s", "e", none.alias("m"), none.alias("left"), none.alias("right"), F.col("s").alias("at"), F.lit(1).alias("late"), F.struct(F.col("e").alias("e"), kind.alias("kind")).alias("reach"))
    tokens = found.filter(F.col("o") == len(KINDS)).select("_at", "_id", "n", "s", "e", "m", "left", "right", F.col("e").alias("at"), F.lit(0).alias("late"), F.lit(None).cast("struct<e:int,kind:string>").alias("reach"))
    so_far = Window.partitionBy("_at").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.unionByName(spans).withColumn("reach", F.max("reach").over(so_far)).filter("n is not null")
    value, start = F.col("m"), F.col("s")
    lead = F.length(F.regexp_extract(value, r"^[^A-Za-z0-9@+]*", 0))
    core = F.regexp_extract(value, r"^[^A-Za-z0-9@+]*(.*?)[^A-Za-z0-9]*$", 1)
    left = F.split(F.lower(F.trim("left")), r"\s+")
    last, before = F.element_at(left, -1), F.when(F.size(left) > 1, F.element_at(left, -2))
    some = lambda c: F.when(F.length(c) > 0, c)
    patterns = F.filter(
        F.array(F.concat(F.lit("2:"), some(before), F.lit(" "), some(last)), F.concat(F.lit("1:"), some(last), F.lit(" _ "), some(F.lower("right")))),
        lambda p: p.isNotNull(),
    )
    told = rows.select(
        "_at", "_id", F.col("n").alias("i"), F.lower(core).alias("value"), (start + lead).alias("s"), (start + lead + F.length(core)).alias("e"),
        F.when(F.col("reach.e") > start, F.col("reach.kind")).alias("base"), patterns.alias("patterns"),
    )
    seed = F.col("base")
    for kind, shape in SHAPES.items():
        seed = F.coalesce(seed, F.when(F.col("value").rlike(shape), kind))
    candidate = (F.length("value") >= 6) & F.col("value").rlike("[0-9].*[0-9]|@")
    return told.withColumn("seed", seed).withColumn("plain", F.col("seed").isNull() & ~candidate).withColumn("base", F.col("base").isNotNull())


def discover(found: DataFrame, support: int = SUPPORT, bar: float = BAR, rounds: int = ROUNDS) -> DataFrame:
    """(_at, i, s, e, kind): instances that patterns of high confidence add."""
    edges = land(
        found.select(F.explode("patterns").alias("pattern"), "value", "seed", "plain").groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.min("plain").alias("plain")),
        "pii-edges",
    )
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("plain").alias("plain"), F.count_if(F.col("seed").isNotNull()).alias("seeds"))
    total = land(total.filter(F.col("seeds") >= support), "pii-totals")  # scores only grow from seeds
    open_edges = edges.filter(~F.col("plain")).select("pattern", "value", "seed").join(total.select("pattern"), "pattern", "left_semi")
    open_edges = land(open_edges, "pii-open-edges")
    seeds = edges.filter("seed is not null").groupBy("value").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    values = land(seeds, "pii-values")
    strong = None
    for _ in range(rounds):
        met = open_edges.select("pattern", "value").join(values, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("seen"))
        among = met.groupBy("pattern").agg(F.sum("sum").alias("all"))
        confidence = F.col("sum") / (F.col("all") + F.col("plain"))
        strong = land(
            met.join(among, "pattern").join(total, "pattern").withColumn("confidence", confidence)
            .filter((F.col("seen") >= support) & (F.col("confidence") >= bar) & (F.col("sum") >= KNOWN * F.col("n"))).select("pattern", "kind", "confidence"),
            "pii-patterns",
        )
        # a value whose patterns all agree with confidence c has 1 - prod(1 - c)
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        new = (
            open_edges.filter("seed is null").select("pattern", "value").join(strong, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("score"))
            .filter(F.col("score") >= bar).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        )
        values = land(seeds.unionByName(new.join(seeds.select("value"), "value", "left_anti")), "pii-values")
    open_ = found.filter(~F.col("base") & ~F.col("plain"))
    hits = open_.select("_at", "_id", "i", "s", "e", "value", F.explode("patterns").alias("pattern")).join(strong, "pattern").join(values.select("value", "kind"), ["value", "kind"])
    return hits.groupBy("_at", "_id", "i", "s", "e").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("_at", "_id", "i", "s", "e", F.col("b.kind").alias("kind"))


def held_out(docs: DataFrame, share: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per kind: seeds hidden by a hash of their value, and how many come back as the right and
    as a wrong kind. It measures the discovery on any corpus without labels."""
    found = land(matches(scan(docs, id_col, text_col)), "pii-matches")
    told = land(instances(found, base_of(found)), "pii-instances")
    hidden = F.col("seed").isNotNull() & (F.pmod(F.xxhash64("value"), F.lit(1000)) < int(1000 * share))
    blind = told.withColumn("truth", F.when(hidden, F.col("seed"))).withColumn("seed", F.when(~hidden, F.col("seed"))).withColumn("base", F.col("base") & F.col("truth").isNull())
    blind = land(blind, "pii-blind")
    back = discover(blind).select("_at", "i", F.col("kind").alias("_kind"))
    asked = blind.filter("truth is not null").select("_at", "i", "truth").join(back, ["_at", "i"], "left")
    return asked.groupBy(F.col("truth").alias("kind")).agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("_kind") == F.col("truth")).alias("right"), F.count_if(F.col("_kind") != F.col("truth")).alias("wrong"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan, base spans, added spans)."""
    scanned = scan(docs, id_col, text_col)
    found = land(matches(scanned), "pii-matches")
    base = base_of(found)
    return scanned, base, discover(land(instances(found, base), "pii-instances"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and spans, arrays of (kind, start, end), in order."""
    scanned, base, more = _found(docs, id_col, text_col)
    order = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])
    rows = base.select("_at", "o", "s", "e", F.lit(True).alias("b")).unionByName(more.select("_at", order[F.col("kind")].alias("o"), "s", "e", F.lit(False).alias("b")))
    span = F.struct("o", "s", "e")
    told = rows.groupBy("_at").agg(F.array_sort(F.collect_list(F.when(F.col("b"), span))).alias("_base"), F.array_sort(F.collect_list(span)).alias("_spans"))
    names = F.array(*map(F.lit, ALL_KINDS))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    shown = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(F.element_at(names, x["o"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))), none)
    return scanned.select("_at", "_id").join(told, "_at", "left").select(F.col("_id").alias(id_col), shown("_base").alias("base"), shown("_spans").alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of its disjoint, ordered spans (s, e, kind) replaced."""
    begin = lambda i: F.when(i > 0, F.element_at(spans, i)["e"]).otherwise(0)
    last = F.element_at(spans, -1)["e"]
    cut = lambda a, n: F.substring(text, a + 1, n)
    whole = lambda part: F.concat(
        F.array_join(F.transform(spans, lambda x, i: F.concat(part(begin(i), x["s"] - begin(i)), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), ""),
        part(last, F.length(text) - last),
    )
    # bound as an argument, the characters are split once, not once a span
    by_chars = F.transform(F.array(F.split(text, "", -1)), lambda chars: whole(lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")))
    return F.when(F.size(spans) <= FEW, whole(cut)).otherwise(by_chars[0])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``<KIND>``; same columns.

    What goes are the spans that ``find`` reports, by their places in the original text;
    spans that overlap go as one, under the kind of the longest.
    """
    scanned, base, more = _found(docs, id_col, text_col)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("o") + 1)
    spans = base.select("_at", "s", "e", kind.alias("kind")).unionByName(more.select("_at", "s", "e", "kind"))
    placed = spans.join(scanned.select("_at", "_id", "_h"), "_at").select("_id", "_h", "s", "e", "kind").distinct()  # repeated rows say the same
    order = Window.partitionBy("_id", "_h").orderBy("s", "e", "kind")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = placed.withColumn("first", F.when(reach > F.col("s"), 0).otherwise(1)).withColumn("g", F.sum("first").over(order))
    longest = F.max(F.struct(F.col("e") - F.col("s"), F.col("kind")))["kind"]
    merged = groups.groupBy("_id", "_h", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), longest.alias("kind"))
    own, at, put = fresh("_own_id", docs), fresh("_own_h", docs), fresh("_places", docs)
    places = merged.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias(put))
    places = land(places.select(row_key(F.col("_id"), F.col("_h")).alias(own), put), "pii-places")
    out = docs.withColumn(at, row_key(F.col(id_col), F.xxhash64(text_col))).join(places, F.col(at) == F.col(own), "left")
    text = F.when(F.col(put).isNull(), F.col(text_col)).otherwise(_replaced(F.col(text_col), F.col(put)))
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
