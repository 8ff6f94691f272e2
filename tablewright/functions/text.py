"""String cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .missing import is_blank, parse_number, strip

# Symbols that surround numbers in text.
NUMBER_SYMBOLS = r"[,$€£₹\s%]"
CURRENCY_SYMBOLS = r"[$€£₹¥]"

TRUE_WORDS = ["true", "1", "1.0", "yes", "y", "t", "active"]
FALSE_WORDS = ["false", "0", "0.0", "no", "n", "f", "inactive"]


def title_case(c: Column) -> Column:
    """Capitalise every run of letters: ``o'neil 3rd`` -> ``O'Neil 3Rd``."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def strip_number(c: Column) -> Column:
    """Drop currency, percent, comma and space characters, then parse.

    The first test fails at the first other character, so long texts are not rewritten.
    """
    candidate = c.rlike(r"^[,$€£₹\s%\d.eE+-]*$")
    return F.when(candidate, parse_number(F.regexp_replace(c, NUMBER_SYMBOLS, "")))


def fixed(c: Column, places: int) -> Column:
    """A number as text with a fixed number of places and no thousands separator."""
    return F.translate(F.format_number(c, places), ",", "")


def parse_boolean(c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


__all__ = ["blank_to_null", "fixed", "is_blank", "parse_boolean", "strip", "strip_number", "title_case"]
