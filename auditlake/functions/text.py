"""Text primitives with the semantics of Python strings, as Catalyst expressions.

Python's ``str`` patterns use its own idea of white space and word characters.
Java's differ (ASCII by default, other sets with ``(?U)``), so both classes are
spelled out here and used instead of ``\\s``, ``\\w`` and ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and word characters of Python's str patterns.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SP = f"[{SPACE_CHARS}]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
# Any character but a newline.
ANY = r"[^\n]"
# Case-insensitive with Unicode folding.
FOLD = "(?iu)"

# The last extension of the last path part; leading dots do not start one.
EXTENSION = r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SP}+|{SP}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE_CHARS}]")


def lines(content: Column) -> Column:
    """Lines as an array; a trailing newline yields a last empty line."""
    return F.split(content, "\n")


def numbered(content: Column) -> Column:
    """``array<struct<line, text>>`` with 1-based line numbers."""
    return F.transform(
        lines(content),
        lambda text, i: F.struct((i + 1).alias("line"), text.alias("text")),
    )


def extension(path: Column) -> Column:
    return F.regexp_extract(path, EXTENSION, 1)


def decode(raw: Column) -> Column:
    """UTF-8 bytes to text: bad bytes become U+FFFD, every line end becomes ``\\n``."""
    return unix_line_ends(F.make_valid_utf8(raw.cast("string")))


def unix_line_ends(text: Column) -> Column:
    replaced = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(F.contains(text, F.lit("\r")), replaced).otherwise(text)


def line_count(content: Column) -> Column:
    return F.size(lines(content))


def token_estimate(content: Column) -> Column:
    """Four characters a token, rounded down per file."""
    return F.floor(F.length(content) / 4).cast("bigint")


def one_decimal(number: Column) -> Column:
    """A non-negative double with one decimal, rounded like Python's ``.1f``.

    Python rounds the exact binary value, ties to even.  ``20 * number`` is
    therefore compared with an odd integer in two subtractions that are exact.
    """
    low = F.floor(number * 10)
    side = (number * 16 - (low * 2 + 1)) + number * 4
    up = (side > 0) | ((side == 0) & (low % 2 == 1))
    tenths = low + up.cast("int")
    return F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))
