"""Identifier normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and zero-width characters that may surround an identifier.
BLANKS = r"[\p{Z}\s\x{200B}\x{FEFF}]+"


def strip(c: Column | str) -> Column:
    """c without white space (Unicode's too) around it; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def norm_id(c: Column | str) -> Column:
    """Lower-case identifier without surrounding white space; null if it is null or blank."""
    s = F.lower(strip(c))
    return F.when(s != "", s)


def det_id(prefix: str, *key: Column) -> Column:
    """Reproducible identifier: prefix, underscore and 8 hexadecimal digits of the natural key's SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 8))
