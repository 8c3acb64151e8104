"""Null-safe numeric column helpers. ANSI mode is on, so every risky cast is a try_cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_double(c: Column) -> Column:
    """Text to double; blank or malformed text is null. NaN text stays NaN."""
    return blank_to_null(c.cast("string")).try_cast("double")


def clip01(c: Column) -> Column:
    # greatest and least skip nulls, so null needs its own branch.
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def clean_risk(c: Column) -> Column:
    """Risk in [0, 1]; blank, malformed and NaN values count as missing."""
    value = to_double(c)
    return F.when(F.isnan(value), None).otherwise(clip01(value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for a zero or null denominator."""
    return F.try_divide(numerator.cast("double"), F.nullif(denominator.cast("double"), F.lit(0.0)))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def percent_error(predicted: Column, reference: Column) -> Column:
    """Absolute percent error, null when the reference is null or zero."""
    return ratio(F.abs(predicted - reference), F.abs(reference)) * F.lit(100.0)


def general_text(c: Column, digits: int = 6) -> Column:
    """Shortest general notation with the given significant digits, without trailing zeros."""
    text = F.format_string(f"%.{digits}g", c.cast("double"))
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    # format_string writes the word null for a null value.
    return F.when(c.isNotNull(), F.regexp_replace(text, r"\.(e|$)", "$1"))


def is_true(c: Column) -> Column:
    """Serialised booleans: only the word true, in any case, is true."""
    return F.lower(F.trim(c.cast("string"))) == "true"
