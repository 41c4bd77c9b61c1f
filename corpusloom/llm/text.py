"""Letters, digits and words, as all operators here understand them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are the longest runs of letters and digits, in lower case.
WORD = re.compile(r"[^\W_]+")
NOT_LETTER_OR_DIGIT = r"[^\p{L}\p{N}]+"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def squeezed(text: Column) -> Column:
    """The sequence of letters and digits without regard to case; the capitals of ß are SS."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), NOT_LETTER_OR_DIGIT, "")


def has_words(text: Column) -> Column:
    """False for null, too."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))
