"""Masks for contact data that may stand inside the free text of a delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as contact data, and its mask. The pattern texts are valid in Java and RE2.
PATTERNS = {
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    "phone": (r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b", "[PHONE]"),
}


def mask(text: Column) -> Column:
    for pattern, token in PATTERNS.values():
        text = F.regexp_replace(text, pattern, token)
    return text


def redact_patterns(deliveries: DataFrame, *columns: str) -> DataFrame:
    """Masked text columns, plus the number of hits per kind over all of them."""
    hits = {
        f"{kind}_hits": sum((F.coalesce(F.regexp_count(F.col(c), F.lit(pattern)), F.lit(0))
                             for c in columns), F.lit(0))
        for kind, (pattern, _) in PATTERNS.items()}
    return deliveries.withColumns(hits).withColumns({c: mask(F.col(c)) for c in columns})
