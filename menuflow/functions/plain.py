"""The plain form of identifiers: half-width, lower case, no blanks at either end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Blanks and signs without width that may surround an identifier.
EDGE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+"


def half_width(c: Column) -> Column:
    """ASCII for the full-width forms of ASCII; the ideographic space becomes a space."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def strip_blanks(c: Column) -> Column:
    """``c`` without blanks or zero-width signs at either end."""
    return F.regexp_replace(c, f"^{EDGE}|{EDGE}$", "")


def plain_form(c: Column) -> Column:
    """Half-width, lower case, without blanks at either end; null stays null. Values that are plain already skip the rewriting."""
    return F.when(c.rlike(r"^[!-@\[-~]+$"), c).otherwise(strip_blanks(F.lower(half_width(c))))
