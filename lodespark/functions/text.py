"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, at an end of a text.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column | str) -> Column:
    """``c`` without white space of any kind at its ends; null stays null."""
    return F.regexp_replace(c, _ENDS, "")


def norm(c: Column | str) -> Column:
    """Stripped and lower case: the identity of claims and questions."""
    return F.lower(strip(c))


def squeeze(c: Column | str) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words_norm(c: Column | str) -> Column:
    """An enumerated label in one spelling: stripped, lower case, blanks and hyphens as ``_``; blank is null."""
    label = F.regexp_replace(norm(c), r"[\s_-]+", "_")
    return F.when(label != "", label)
