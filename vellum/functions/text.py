"""String functions whose semantics follow Python's ``str`` methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading or trailing whitespace in the Unicode sense, as Python's str.strip().
_EDGE_WS = r"(?U)^\s+|\s+$"
# Runs of cased letters (Lu, Ll, Lt) and of everything else; as in Python,
# a cased letter after any uncased character starts a new word.
_LETTER_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip_whitespace(c: Column) -> Column:
    """``str.strip()``: Spark's ``trim`` removes spaces only, not tabs."""
    return F.regexp_replace(c, _EDGE_WS, "")


def title_case(c: Column) -> Column:
    """``str.title()``: a letter after any non-letter starts a word.

    ``initcap`` only starts words after whitespace (``O'neil``), so the
    text is split into letter / non-letter runs and each run is capitalised.
    """
    runs = F.regexp_extract_all(c, F.lit(_LETTER_RUNS), 1)
    return F.when(c.isNull(), None).otherwise(
        F.array_join(F.transform(runs, lambda x: F.initcap(x)), ""))


# The tokens removed from join-key names, in this order.
NAME_TOKENS = ["_id", "id", "_key", "key"]


def normalise_name(c: Column) -> Column:
    """Join-key name normalisation: lower case, drop ``_id``, ``id``,
    ``_key`` and ``key`` anywhere (in that order), then strip ``_`` and
    spaces at both ends."""
    x = F.lower(c)
    for token in NAME_TOKENS:
        x = F.replace(x, F.lit(token), F.lit(""))
    return F.regexp_replace(x, r"^[_ ]+|[_ ]+$", "")
