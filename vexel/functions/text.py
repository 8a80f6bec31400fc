"""Words of a text, as the random projection counts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower(text: Column) -> Column:
    """Lower case letter by letter: two capitals that Java treats by context go first."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def tokenize(text: Column | str) -> Column:
    """Runs of letters and decimal digits of two bytes or more, in lower case and in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: F.octet_length(t) >= 2)
