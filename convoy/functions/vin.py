"""Vehicle identification number checks as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from convoy.schemas import VIN_LETTER_DIGITS, VIN_LETTERS, VIN_PATTERN, VIN_WEIGHTS


def check_digit(vin: Column) -> Column:
    """Weighted sum of the seventeen coded characters modulo 11, ten written as X.

    One pass over an array: spelt out as seventeen terms, the generated method grows beyond what the
    JVM compiles and runs interpreted.
    """
    coded = F.split(F.translate(vin, VIN_LETTERS, VIN_LETTER_DIGITS), "")
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])
    terms = F.zip_with(coded, weights, lambda c, w: c.try_cast("int") * w)
    rest = F.aggregate(terms, F.lit(0), lambda total, term: total + term) % 11
    return F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string"))


def packed_check_digit(vin: Column) -> Column:
    """:func:`check_digit` of a text of the VIN's characters, at a fraction of the cost, as a column of its own.

    The eight digits on either side of the ninth, which has no weight, are read as one hexadecimal number, and shifts
    take them out of it. Inside a condition Spark would read the number anew for every digit.
    """
    coded = F.translate(vin, VIN_LETTERS, VIN_LETTER_DIGITS)
    total = F.lit(0)
    for start, weights in ((1, VIN_WEIGHTS[:8]), (10, VIN_WEIGHTS[9:])):
        packed = F.conv(F.substring(coded, start, 8), 16, 10).try_cast("bigint")
        for place, weight in enumerate(weights):
            total = total + F.shiftright(packed, 4 * (7 - place)).bitwiseAND(F.lit(15)).cast("int") * weight
    return F.substring(F.lit("0123456789X"), total % 11 + 1, F.lit(1))


def vin_problem(vin: Column, check: Column | None = None) -> Column:
    """Null for a valid VIN, else ``length``, ``charset`` or ``check_digit``; ``check`` is its check digit if there is a column of it."""
    upper = F.upper(vin)
    return (
        F.when(vin.isNull() | (F.length(upper) != 17), F.lit("length"))
        .when(~upper.rlike(VIN_PATTERN), F.lit("charset"))
        .when(F.substring(upper, 9, 1) != (check_digit(upper) if check is None else check), F.lit("check_digit"))
    )


def is_valid_vin(vin: Column, check: Column | None = None) -> Column:
    return vin_problem(vin, check).isNull()
