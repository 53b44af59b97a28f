"""Number and text rendering used in human-readable messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import col


def general(value: Column | str) -> Column:
    """Six significant digits without trailing zeros, e.g. 2.0 -> '2'."""
    value = col(value).cast("double")
    scientific = F.format_string("%.5e", value)
    exponent = F.substring_index(scientific, "e", -1)
    mantissa = F.regexp_replace(F.substring_index(scientific, "e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(scientific.try_cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    power = exponent.try_cast("int")
    return F.when(value.isNotNull(), F.when(
        (value == 0) | power.between(-4, 5), plain).otherwise(F.concat(mantissa, F.lit("e"), exponent)))


def decimal_text(value: Column | str) -> Column:
    """Shortest form that keeps one decimal: 211400.0, 3.5."""
    value = col(value).cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
    return F.when(whole, F.format_string("%.1f", value)).otherwise(value.cast("string"))


def amount_text(value: Column | str) -> Column:
    """Whole amounts without a decimal point, others as they are."""
    value = col(value).cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
    return F.when(whole, F.format_string("%.0f", value)).otherwise(value.cast("string"))


def quoted(value: Column | str) -> Column:
    """Quoted text with escapes; NULL shows as None."""
    value = col(value)
    escaped = value
    for raw in "\\\n\r\t\x0b\x0c\xa0":
        escaped = F.replace(escaped, F.lit(raw), F.lit(repr(raw)[1:-1]))
    has_single, has_double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.coalesce(F.when(has_single & ~has_double, double).otherwise(single), F.lit("None"))


def quoted_list(values: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col(values), quoted), ", "), F.lit("]"))
