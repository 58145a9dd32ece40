"""The text segment format, as an import and export format.

A segment is a text file: a preamble that names table, fields and lookups, then one
operation per line, put (``R``) or tombstone (``D``), cells separated by tabs with escapes.
Chunks are named in base 36 counting down, so descending names are oldest first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.text import chunk_name_text, chunk_number, escape, escape_text, parse_cell, unescape, value_text
from ..schema import Table
from .files import Files

#: Fixed values of the format.
MAGIC, VERSION, PROFILE, SUFFIX = "SIX", 1, "table", ".6"
#: A chunk takes no further batch beyond this size.
CHUNK_BYTES = 1 << 20
#: A batch of more than so many caps is written as parts of its own, in order.
WHOLE = 64


def header(table: Table) -> str:
    return "\t".join(table.names)


def preamble(table: Table, schema_hash: str) -> str:
    """The self-describing start of a segment."""
    lines = ["\t".join([MAGIC, str(VERSION), PROFILE, escape_text(table.name), schema_hash])]
    lines += [f"@field\t{escape_text(f.name)}\t{f.kind}" for f in table.fields]
    lines += [f"@lookup\t{escape_text(x.field)}\t{'unique' if x.unique else 'many'}" for x in table.all_lookups]
    return "\n".join([*lines, "@data"]) + "\n"


def row_text(table: Table) -> Column:
    return F.concat_ws("\t", *[escape(value_text(F.col(f.name), f.kind)) for f in table.fields])


def encode(log: DataFrame, table: Table) -> DataFrame:
    """``log`` with ``line``, its operation as text."""
    tx = F.col("_tx").cast("string")
    put = F.concat_ws("\t", F.lit("R"), tx, row_text(table))
    gone = F.concat_ws("\t", F.lit("D"), tx, escape(F.col("id")))
    return log.withColumn("line", F.when(F.col("_op") == "R", put).otherwise(gone))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_chunk, _pos, line): lines of all segments below a folder, places from the files."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{SUFFIX}")
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"([^/]+)\{SUFFIX}$", 1)
    return files.select(name.alias("_chunk"), F.posexplode(F.split("value", "\n", -1)).alias("_pos", "line"))


def decode(lines: DataFrame, table: Table) -> DataFrame:
    """(_batch, _pos, _tx, _op, fields): operations of a table's segments.

    Blank, magic and ``@`` lines are skipped; a line without a tag is a put of tx 0; a
    legacy header line is skipped. Anything else that breaks the format raises.
    """
    line = F.col("line")
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), line))
    skip = (line == "") | line.startswith(f"{MAGIC}\t") | line.startswith("@") | (line == F.lit(header(table)))
    tagged = line.rlike("^[RD]\t")
    head = F.split(line, "\t", 3)
    arity = F.size(head) == 3
    tx_text = F.try_element_at(head, F.lit(2))
    tx = F.when(~tagged, F.lit(0).cast("long")).when(~arity, fail("operation needs three columns").cast("long")).when(tx_text.rlike(r"^\+?[0-9]+\z"), F.coalesce(tx_text.try_cast("long"), fail("bad transaction id").cast("long"))).otherwise(fail("bad transaction id").cast("long"))
    op = F.when(tagged, F.substring(line, 1, 1)).otherwise("R")
    tail = F.when(tagged, F.coalesce(F.try_element_at(head, F.lit(3)), F.lit(""))).otherwise(line)
    n = len(table.fields)
    cells = F.split(tail, "\t", -1)
    checked = F.when((F.col("_op") == "R") & (F.size("_cells") != n), F.raise_error(F.concat(F.lit(f"row of {table.name} needs {n} columns: "), line))).otherwise(F.col("_cells"))
    rows = (
        lines.filter(~skip)
        .select("_chunk", "_pos", "line", tx.alias("_tx"), op.alias("_op"), tail.alias("_tail"), cells.alias("_cells"))
        .withColumn("_cells", checked)
    )
    put = F.col("_op") == "R"
    fields = []
    for i, f in enumerate(table.fields):
        value = parse_cell(unescape(F.try_element_at("_cells", F.lit(i + 1))), f.kind, f.name)
        other = unescape(F.col("_tail")) if f.name == "id" else F.lit(None)
        fields.append(F.when(put, value).otherwise(other.cast(value_type(f.kind))).alias(f.name))
    return rows.select(chunk_number(F.col("_chunk")).alias("_batch"), F.col("_pos").cast("long").alias("_pos"), "_tx", "_op", *fields)


def value_type(kind: str) -> str:
    return {"int": "long", "float": "double", "bool": "boolean"}.get(kind, "string")


def check_header(lines: DataFrame, table: Table) -> None:
    """Raise if a file starts with neither the magic line nor the legacy header."""
    bad = lines.filter((F.col("_pos") == 0) & ~(F.col("line").startswith(f"{MAGIC}\t") | (F.col("line") == header(table)))).first()
    if bad:
        raise FormatError(f"segment {bad['_chunk']} of {table.name} starts with {bad['line'][:60]!r}")


def plan_chunks(sizes: list[int], cap: int = CHUNK_BYTES, first: int = 0, room: int | None = None) -> list[int]:
    """The chunk of each batch: no batch is split, and a chunk that the next batch would
    take beyond the cap is closed. ``room`` is what chunk ``first`` already holds."""
    out, chunk, held = [], first, room or 0
    for n in sizes:
        if held and held + n > cap:
            chunk, held = chunk + 1, 0
        out.append(chunk)
        held += n
    return out


def chunked(log: DataFrame, table: Table, cap: int = CHUNK_BYTES) -> DataFrame:
    """(_chunk_no, _batch, _pos, line): where export puts each operation.

    A log of any size has places; export refuses one of more chunks than there are names.
    """
    return _chunked(log, table, cap)[0]


def _chunked(log: DataFrame, table: Table, cap: int) -> tuple[DataFrame, int]:
    """As ``chunked``, and the number of chunks.

    A batch beyond ``WHOLE`` caps (a bulk load, a compacted table) falls into parts of equal
    ranges of its positions, each planned as a batch; chunks in order are the log in order.
    What shares a position stays together, so there are no more parts than positions.
    """
    lines = encode(log, table).select("_batch", "_pos", "line")
    size = F.sum(F.octet_length("line") + 1).alias("n")
    # one row per batch
    sizes = lines.groupBy("_batch").agg(size, F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).orderBy("_batch").collect()
    planned, parts = [], []
    for r in sizes:
        k = min(-(-r["n"] // (cap * WHOLE)), r["hi"] - r["lo"] + 1)
        parts.append((r["_batch"], r["lo"], (r["hi"] - r["lo"] + 1) / k, len(planned)))
        planned += [r["n"] // k] * k
    chunks = plan_chunks(planned, cap)
    spark = log.sparkSession
    where = spark.createDataFrame([(b, lo, width, at) for b, lo, width, at in parts], "_batch long, _lo long, _width double, _at long")
    of = spark.createDataFrame(list(enumerate(chunks)), "_part long, _chunk_no int")
    placed = lines.join(where, "_batch").withColumn("_part", F.col("_at") + F.floor((F.col("_pos") - F.col("_lo")) / F.col("_width")).cast("long"))
    return placed.join(of, "_part").select("_chunk_no", "_batch", "_pos", "line"), max(chunks, default=-1) + 1


def export(log: DataFrame, table: Table, schema_hash: str, folder: str, cap: int = CHUNK_BYTES) -> int:
    """Write a log as segments below ``folder``; the number of chunks.

    Every chunk is a task's rows in order, written line by line, so no chunk is held in memory.
    """
    spark = log.sparkSession
    placed, n = _chunked(log, table, cap)
    chunk_name_text(max(0, n - 1))
    files = Files(spark, folder)
    work = files.at(f"_writing-{uuid.uuid4().hex[:12]}")
    heads = spark.createDataFrame([(c, -1, -1, preamble(table, schema_hash)[:-1]) for c in range(n)], "_chunk_no int, _batch long, _pos long, line string")
    name = F.concat(F.lit("c"), F.col("_chunk_no").cast("string")).alias("_name")
    # the writer keeps the order inside a file as long as it starts with the file's name
    rows = placed.unionByName(heads).withColumn("_name", name).repartition(max(1, n), "_name").sortWithinPartitions("_name", "_batch", "_pos")
    rows.select(F.col("line").alias("value"), "_name").write.partitionBy("_name").text(work)
    for c in range(n):
        part = next(x for x in files.names(f"{work}/_name=c{c}") if x.startswith("part-"))
        target = files.at(chunk_name_text(c) + SUFFIX)
        if files.exists(target):
            raise FormatError(f"{target} exists")
        files.rename(f"{work}/_name=c{c}/{part}", target)
    files.delete(work)
    return n


def load(spark: SparkSession, folder: str, table: Table, check: bool = True) -> DataFrame:
    """The log that a folder of segments holds."""
    lines = read_lines(spark, folder)
    if check:
        check_header(lines, table)
    return decode(lines, table)


def broken_end(line: Column, table: Table) -> Column:
    """Whether a last line without its line break is no whole operation.

    What parses is kept: a line break alone may be what is missing.
    """
    head = F.split(line, "\t", 3)
    put = F.split(F.try_element_at(head, F.lit(3)), "\t", -1)
    whole = F.lit(True)
    for i, f in enumerate(table.fields):
        cell = F.try_element_at(put, F.lit(i + 1))
        pattern = {"int": r"^[+-]?[0-9]+\z", "float": r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z", "bool": r"^(true|false)\z"}.get(f.kind)
        sound = ~F.regexp_replace(cell, r"\\[\\tnr]", "").contains("\\")
        whole &= (cell.rlike(pattern) if pattern else sound)
    tx = F.try_element_at(head, F.lit(2)).rlike(r"^[0-9]+\z")
    told = F.when(line.startswith("R\t"), tx & (F.size(put) == len(table.fields)) & F.coalesce(whole, F.lit(False)))
    gone = F.when(line.startswith("D\t"), tx & (F.length(F.try_element_at(head, F.lit(3))) > 0))
    return ~F.coalesce(told, gone, F.lit(False))


def repair(lines: DataFrame, table: Table) -> DataFrame:
    """``lines`` without broken last lines: those without a line break that are no whole operation."""
    from pyspark.sql.window import Window

    last = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.col("_pos").desc())) == 1
    dropped = F.col("_last") & (F.col("line") != "") & broken_end(F.col("line"), table)
    return lines.withColumn("_last", last).filter(~dropped).drop("_last")


def repair_files(spark: SparkSession, folder: str, table: Table) -> dict[str, int]:
    """Rewrite the segments of a folder whose last line is broken or lacks its line break.

    Every line that stays must decode, or nothing is changed. Returns the number of files
    rewritten, the operations left and the next transaction id. A mended file is written whole
    beside the old one before it takes its place.
    """
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{SUFFIX}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    open_ = found.filter((F.length("value") > 0) & ~F.col("value").endswith("\n")).select(name.alias("_file"), "value")
    lines = repair(read_lines(spark, folder), table)
    check_header(lines, table)
    left, top = decode(lines, table).agg(F.count(F.lit(1)), F.max("_tx")).first()
    end = F.substring_index("value", "\n", -1)  # the writer ends the last line that stays
    mended = open_.withColumn("_end", end).withColumn(
        "value", F.when(broken_end(F.col("_end"), table), F.expr("substring(value, 1, length(value) - length(_end) - 1)")).otherwise(F.col("value"))
    )
    files = Files(spark, folder)
    work = files.at(f"_mending-{uuid.uuid4().hex[:12]}")
    mended.select(F.col("_file").alias("_name"), "value").repartition("_name").write.partitionBy("_name").text(work)
    names = [x.split("=", 1)[1] for x in files.names(work) if "=" in x]
    for n in names:
        part = next(x for x in files.names(f"{work}/_name={n}") if x.startswith("part-"))
        files.rename(files.at(n), f"{work}/{n}.old")
        files.rename(f"{work}/_name={n}/{part}", files.at(n))
    files.delete(work)
    return {"files": len(names), "operations": left, "next_tx": (top or 0) + 1}
