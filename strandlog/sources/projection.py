"""Generated lookup state in its older text form, as an import format.

The first line names version, table and the hashes of schema and source; the others are
row pointers (id, chunk, byte offset, length, transaction id) and lookup entries (field, key, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.text import unescape, unescape_text

#: Fixed value of the format.
MAGIC = "SIXB"


def read(spark: SparkSession, path: str) -> tuple[dict[str, str | int], DataFrame, DataFrame]:
    """(head, rows, lookups) of one file: id, chunk, offset, length, _tx; field, key, id.

    Blank lines are skipped; any other line that is neither raises when the frames are read.
    """
    lines = spark.read.text(path)
    first = lines.first()  # a text scan starts at the file's start
    cells = (first[0] if first else "").split("\t")
    if len(cells) != 5 or cells[0] != MAGIC or not cells[1].isdigit():
        raise FormatError(f"{path} starts with {(first[0] if first else '')[:60]!r}")
    head = dict(zip(("version", "table", "schema_hash", "source_hash"), [int(cells[1]), *map(unescape_text, cells[2:])]))
    part = F.split("value", "\t", -1)
    row, entry = (part[0] == "row") & (F.size(part) == 6), (part[0] == "lookup") & (F.size(part) == 4)
    bad = F.raise_error(F.concat(F.lit("no entry: "), F.col("value")))
    known = lines.filter((F.trim("value") != "") & ~F.col("value").startswith(f"{MAGIC}\t"))
    kind = F.when(row, "row").when(entry, "lookup").otherwise(bad)
    told = known.select(kind.alias("kind"), part.alias("p"), "value")
    number = lambda i: F.when(F.col("p")[i].rlike(r"^\+?[0-9]+\z"), F.col("p")[i].cast("long")).otherwise(bad.cast("long"))
    text = lambda i: unescape(F.col("p")[i])
    rows = told.filter("kind = 'row'").select(text(1).alias("id"), text(2).alias("chunk"), number(3).alias("offset"), number(4).alias("length"), number(5).alias("_tx"))
    lookups = told.filter("kind = 'lookup'").select(text(1).alias("field"), text(2).alias("key"), text(3).alias("id"))
    return head, rows, lookups
