"""The conversation pack: blocks of messages, tags, properties, tool calls and results.

A block starts with a ``C`` line; the lines up to the next belong to it. Block ids are
carried down each file by a window, so a file is one window's rows; packs are meant to be
many files of some megabytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape, escape_text, unescape

#: Fixed values of the format: profile and record tags with their number of columns.
PROFILE = "chatpack"
COLUMNS = {"C": 5, "M": 4, "G": 2, "P": 3, "T": 5, "R": 4, "D": 2, "U": 4}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _pos, line)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\n", -1)).alias("_pos", "line")).filter("line <> ''")


def records(found: DataFrame) -> DataFrame:
    """(_file, _pos, tag, cid, cells): records with their block's id; last cells are tails.

    Raises on unknown tags, missing columns, bad escapes and records before any block.
    """
    line = F.col("line")
    tag = F.split(line, "\t", 2)[0]
    rows = found.filter(~line.startswith("@") & ~line.startswith("SIX\t")).withColumn("tag", tag)
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), line))
    cells: Column = bad("unknown record").cast("array<string>")
    for t, n in COLUMNS.items():
        split = F.split(line, "\t", n)
        whole = F.when(F.size(split) == n, F.transform(F.slice(split, 2, n - 1), unescape)).otherwise(bad(f"{t} needs {n - 1} columns").cast("array<string>"))
        cells = F.when(F.col("tag") == t, whole).otherwise(cells)
    rows = rows.withColumn("cells", cells)
    down = Window.partitionBy("_file").orderBy("_pos")
    block = F.last(F.when(F.col("tag") == "C", F.col("cells")[0]), ignorenulls=True).over(down)
    own = F.when(F.col("tag").isin("D", "U"), F.col("cells")[0]).otherwise(block)
    return rows.withColumn("cid", own).withColumn("cid", F.when(F.col("cid").isNull(), bad("record outside a block")).otherwise(F.col("cid")).cast("long")).select("_file", "_pos", "tag", "cid", "cells")


def dictionaries(found: DataFrame) -> DataFrame:
    """(name, code, value): entries of ``@role``, ``@source`` and so on."""
    parts = F.split("line", "\t", 3)
    return found.filter(F.col("line").startswith("@") & (F.size(parts) == 3)).select(F.substring(parts[0], 2, 100).alias("name"), parts[1].alias("code"), unescape(parts[2]).alias("value"))


def conversations(r: DataFrame) -> DataFrame:
    c = F.col("cells")
    return r.filter("tag = 'C'").select("cid", c[1].cast("long").alias("source_id"), c[2].cast("long").alias("domain_id"), c[3].cast("long").alias("flags"))


def messages(r: DataFrame) -> DataFrame:
    """(cid, turn, role, text); a turn that a block holds twice raises."""
    c = F.col("cells")
    rows = r.filter("tag = 'M'").select("cid", c[0].cast("long").alias("turn"), c[1].alias("role"), c[2].alias("text"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("cid", "turn")) > 1
    return rows.withColumn("text", F.when(twice, F.raise_error(F.concat(F.lit("turn twice in block "), F.col("cid").cast("string")))).otherwise(F.col("text")))


def tags(r: DataFrame) -> DataFrame:
    return r.filter("tag = 'G'").select("cid", F.col("cells")[0].cast("long").alias("tag_id"))


def properties(r: DataFrame) -> DataFrame:
    return r.filter("tag = 'P'").select("cid", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("value"))


def calls(r: DataFrame) -> DataFrame:
    c = F.col("cells")
    return r.filter("tag = 'T'").select("cid", c[0].cast("long").alias("turn"), c[1].cast("long").alias("call"), c[2].cast("long").alias("tool_id"), c[3].alias("args"))


def results(r: DataFrame) -> DataFrame:
    c = F.col("cells")
    return r.filter("tag = 'R'").select("cid", c[0].cast("long").alias("turn"), c[1].cast("long").alias("call"), c[2].alias("text"))


def with_updates(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, properties) after ``U`` and ``D`` records, the last one winning."""
    order = Window.partitionBy("cid", "path").orderBy(F.col("_file").desc(), F.col("_pos").desc())
    updates = r.filter("tag = 'U'").select("cid", "_file", "_pos", F.col("cells")[1].alias("path"), F.col("cells")[2].alias("value"))
    last = updates.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select("cid", "path", "value")
    gone = r.filter("tag = 'D'").select("cid").distinct()
    flags = last.filter("path = 'flags'").select("cid", F.col("value").cast("long").alias("_flags"))
    convs = conversations(r).join(gone, "cid", "left_anti").join(flags, "cid", "left").withColumn("flags", F.coalesce("_flags", "flags")).drop("_flags")
    new = last.filter(F.col("path").startswith("P.")).select("cid", F.substring("path", 3, 1000).alias("key"), F.col("value").alias("_new"))
    props = properties(r).join(new, ["cid", "key"], "full").select("cid", "key", F.coalesce("_new", "value").alias("value")).join(gone, "cid", "left_anti")
    return convs, props


def encode(convs: DataFrame, msgs: DataFrame, tagged: DataFrame | None = None, props: DataFrame | None = None, called: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """(cid, block): each conversation as the text of one block.

    Takes what the readers give: ``tags``, ``properties``, ``calls`` and ``results`` besides messages.
    """
    text = lambda *c: F.concat_ws("\t", *c)
    number = lambda c: F.col(c).cast("string")
    parts = [msgs.select("cid", F.lit(0).alias("o"), F.col("turn").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c"), text(F.lit("M"), number("turn"), F.col("role"), escape(F.col("text"))).alias("line"))]
    zero, no = F.lit(0).cast("long"), F.lit("")
    if tagged is not None:
        parts.append(tagged.select("cid", F.lit(1).alias("o"), F.col("tag_id").alias("a"), zero.alias("b"), no.alias("c"), text(F.lit("G"), number("tag_id")).alias("line")))
    if props is not None:
        parts.append(props.select("cid", F.lit(2).alias("o"), zero.alias("a"), zero.alias("b"), F.col("key").alias("c"), text(F.lit("P"), escape(F.col("key")), escape(F.col("value"))).alias("line")))
    if called is not None:
        parts.append(called.select("cid", F.lit(3).alias("o"), F.col("turn").alias("a"), F.col("call").alias("b"), no.alias("c"), text(F.lit("T"), number("turn"), number("call"), number("tool_id"), escape(F.col("args"))).alias("line")))
    if told is not None:
        parts.append(told.select("cid", F.lit(4).alias("o"), F.col("turn").alias("a"), F.col("call").alias("b"), no.alias("c"), text(F.lit("R"), number("turn"), number("call"), escape(F.col("text"))).alias("line")))
    rows = reduce(DataFrame.unionByName, parts)
    said = rows.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("o", "a", "b", "c", "line"))).alias("m"))
    head = F.concat_ws("\t", F.lit("C"), *[F.col(c).cast("string") for c in ("cid", "source_id", "domain_id", "flags")])
    none = F.array().cast("array<string>")
    return convs.join(said, "cid", "left").select("cid", F.array_join(F.concat(F.array(head), F.coalesce(F.transform("m", lambda x: x["line"]), none)), "\n").alias("block"))


def encode_updates(updates: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(cid, line): field updates (cid, path, value) and tombstones (cid) as records."""
    out = []
    if updates is not None:
        out.append(updates.select("cid", F.concat_ws("\t", F.lit("U"), F.col("cid").cast("string"), escape(F.col("path")), escape(F.col("value"))).alias("line")))
    if gone is not None:
        out.append(gone.select("cid", F.concat_ws("\t", F.lit("D"), F.col("cid").cast("string")).alias("line")))
    return reduce(DataFrame.unionByName, out)


def preamble(entries: dict[str, dict[str, str]] | None = None) -> str:
    """The magic line and the entries of dictionaries: {"role": {"u": "user"}}."""
    rows = [f"SIX\t1\t{PROFILE}\tstrandlog"]
    rows += ["\t".join([f"@{name}", escape_text(code), escape_text(value)]) for name, codes in (entries or {}).items() for code, value in codes.items()]
    return "\n".join(rows) + "\n"


def write(convs: DataFrame, msgs: DataFrame, path: str, entries: dict[str, dict[str, str]] | None = None, **more: DataFrame) -> None:
    """Packs below ``path``, one file per task, each with its magic line and dictionaries;
    ``more`` are the further records that ``encode`` takes."""
    blocks = encode(convs, msgs, **more)
    first = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("cid")) == 1
    blocks.select(F.when(first, F.concat(F.lit(preamble(entries)), F.col("block"))).otherwise(F.col("block")).alias("value")).write.text(path)


def write_updates(path: str, updates: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Update records as further files of a pack."""
    lines_ = encode_updates(updates, gone)
    first = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("cid", "line")) == 1
    lines_.select(F.when(first, F.concat(F.lit(preamble()), F.col("line"))).otherwise(F.col("line")).alias("value")).write.mode("append").text(path)
