"""Cell text: escapes, value text, chunk names.

Column functions stay in the JVM. Bad input raises in the running task; nothing turns
into null silently.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError

#: Escapes of a cell; fixed values of the format.
ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
#: Chunks count down from here in base 36, so names sort newest first.
LAST_CHUNK = 36**3 - 1


def escape(c: Column) -> Column:
    for raw, out in ESCAPES.items():
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def unescape(c: Column) -> Column:
    """Inverse of ``escape``; unknown and dangling escapes raise.

    Split at double backslashes, no part holds one that is not its own escape.
    """
    bad = F.raise_error(F.concat(F.lit("bad escape in cell: "), c))
    whole = c.rlike(r"^([^\\]|\\[\\tnr])*+\z")
    parts = F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    plain = ~c.contains("\\")
    return F.when(plain, c).when(whole, F.array_join(parts, "\\")).otherwise(bad)


def escape_text(s: str) -> str:
    return "".join(ESCAPES.get(ch, ch) for ch in s)


def toml_text(s: str) -> str:
    """Text for a quoted TOML value: quotes and backslashes get a backslash."""
    return "".join("\\" + ch if ch in '"\\' else ch for ch in s)


def unescape_text(s: str) -> str:
    back = {v[1]: k for k, v in ESCAPES.items()}
    out, chars = [], iter(s)
    for ch in chars:
        if ch != "\\":
            out.append(ch)
            continue
        nxt = next(chars, None)
        if nxt not in back:
            raise FormatError("dangling escape" if nxt is None else f"unknown escape \\{nxt}")
        out.append(back[nxt])
    return "".join(out)


def float_text(x: float) -> str:
    """Shortest decimal text without exponent: 1.0 is ``1``, 1e21 has 22 digits."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    out = format(Decimal(repr(x)), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def float_column_text(c: Column) -> Column:
    """``float_text`` over a column.

    The engine's shortest text gives digits and exponent; zeros are then laid out by rule.
    Subnormal values may come out with a digit more than the shortest text has.
    """
    # the engine's own text may hold a digit too many: shorter ones count if they read back
    short = lambda n: F.regexp_replace(F.upper(F.format_string(f"%.{n}e", c)), r"E\+?", "E")
    reads = lambda t: t.try_cast("double") == c
    finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) & (c != 0)
    texts = F.when(finite, F.filter(F.array(short(14), short(15), short(16), c.cast("string")), reads))
    laid = F.transform(F.slice(texts, 1, 1), _laid_out)[0]  # a lambda's argument is computed once
    zero = F.when(c.cast("string").startswith("-"), "-0").otherwise("0")
    return F.when(F.isnan(c), "NaN").when(c == F.lit(float("inf")), "inf").when(c == F.lit(float("-inf")), "-inf").when(c == 0, zero).otherwise(laid)


def _laid_out(s: Column) -> Column:
    """Text with an exponent as plain decimal text."""
    sign = F.when(s.startswith("-"), "-").otherwise("")
    parts = F.split(F.regexp_replace(s, "^-", ""), "E")
    exponent = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0))
    halves = F.split(parts[0], r"\.")
    rest = F.regexp_replace(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), "0+$", "")
    digits = F.concat(halves[0], rest)
    point = F.length(halves[0]) + exponent
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    left = F.when(point <= 0, F.lit("0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), zeros(point - F.length(digits))))
    right = F.when(point <= 0, F.concat(zeros(-point), digits)).otherwise(F.substring(digits, point + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    left = F.regexp_replace(left, "^0+(?=[0-9])", "")
    return F.concat(sign, left, F.when(F.length(right) > 0, F.concat(F.lit("."), right)).otherwise(""))


def value_text(c: Column, kind: str) -> Column:
    """A value's text, as lookups compare it and cells hold it."""
    return float_column_text(c) if kind == "float" else c.cast("string")


def key_text(value) -> str:
    """The text of a lookup key."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return float_text(value) if isinstance(value, float) else str(value)


def parse_cell(c: Column, kind: str, name: str) -> Column:
    """A cell's typed value; text that is not exactly of the kind raises."""
    bad = F.raise_error(F.concat(F.lit(f"field {name} is no {kind}: "), c))
    if kind == "int":
        return F.when(c.rlike(r"^[+-]?[0-9]+\z"), F.coalesce(c.try_cast("long"), bad.cast("long"))).otherwise(bad.cast("long"))
    if kind == "float":
        number = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)\z"
        special = F.lower(c).rlike(r"^[+-]?(inf|infinity|nan)\z")
        word = F.when(F.lower(c).contains("nan"), F.lit("NaN")).when(c.startswith("-"), "-Infinity").otherwise("Infinity")
        return F.when(c.rlike(number), c.try_cast("double")).when(special, word.cast("double")).otherwise(bad.cast("double"))
    if kind == "bool":
        return F.when(c == "true", True).when(c == "false", False).otherwise(bad.cast("boolean"))
    return c


def chunk_name(k: Column) -> Column:
    """Name of chunk k: three digits in base 36, counting down."""
    bad = F.raise_error(F.concat(F.lit("no name for chunk "), k.cast("string")))
    return F.when((k < 0) | (k > LAST_CHUNK), bad.cast("string")).otherwise(F.lower(F.lpad(F.conv((LAST_CHUNK - k).cast("string"), 10, 36), 3, "0")))


def chunk_number(name: Column) -> Column:
    return LAST_CHUNK - F.conv(F.upper(name), 36, 10).cast("long")


def chunk_name_text(k: int) -> str:
    if not 0 <= k <= LAST_CHUNK:
        raise FormatError(f"no name for chunk {k}")
    n, out = LAST_CHUNK - k, ""
    for _ in range(3):
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def clean_text(c: Column, fallback: str) -> Column:
    """Text without surrounding white space, or the fallback where none is left."""
    trimmed = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit(fallback))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())
