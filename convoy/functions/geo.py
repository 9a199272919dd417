"""Geohash cells and great-circle distance as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from convoy.schemas import EARTH_RADIUS_KM, GEOHASH_ALPHABET


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _axis_index(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the dyadic slice of [low, low + span) that holds ``value``.

    The quotient can round across a slice edge, so it is corrected against the edges, which are
    exact in binary. Values outside the axis land in its first or last slice.
    """
    slices = float(2**bits)
    guess = F.floor((value - low) / span * slices)
    edge = F.lit(low) + guess * F.lit(span / slices)
    fixed = (
        F.when(value < edge, guess - 1)
        .when(value >= edge + F.lit(span / slices), guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(2**bits - 1).cast("bigint"), fixed))


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Base-32 cell name; longitude and latitude bits alternate, longitude first."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    lon_index = _axis_index(lon, -180.0, 360.0, lon_bits)
    lat_index = _axis_index(lat, -90.0, 180.0, lat_bits)

    def bit(position: int) -> Column:
        if position % 2 == 0:
            return F.shiftright(lon_index, lon_bits - 1 - position // 2).bitwiseAND(F.lit(1))
        return F.shiftright(lat_index, lat_bits - 1 - position // 2).bitwiseAND(F.lit(1))

    letters = []
    for first in range(0, total, 5):
        code = reduce(
            lambda a, b: a + b, [bit(first + j) * F.lit(2 ** (4 - j)) for j in range(5)]
        )
        letters.append(F.substr(F.lit(GEOHASH_ALPHABET), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash_bounds(cell: Column, precision: int = 7) -> tuple[Column, Column, Column, Column]:
    """Centre latitude and longitude with their half widths; all null for a name that is no cell."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    codes = [
        F.instr(F.lit(GEOHASH_ALPHABET), F.substr(cell, F.lit(i + 1), F.lit(1))) - 1
        for i in range(precision)
    ]
    legal = cell.rlike(f"^[{GEOHASH_ALPHABET}]{{{precision}}}$")

    def axis(offset: int, bits: int) -> Column:
        parts = []
        for n in range(bits):
            position = 2 * n + offset
            digit = F.shiftright(codes[position // 5], 4 - position % 5).bitwiseAND(F.lit(1))
            parts.append(digit.cast("bigint") * F.lit(2 ** (bits - 1 - n)))
        return reduce(lambda a, b: a + b, parts)

    lat_err, lon_err = 90.0 / 2**lat_bits, 180.0 / 2**lon_bits
    lat = F.lit(-90.0) + (axis(1, lat_bits) * 2 + 1) * F.lit(lat_err)
    lon = F.lit(-180.0) + (axis(0, lon_bits) * 2 + 1) * F.lit(lon_err)
    return (
        F.when(legal, lat),
        F.when(legal, lon),
        F.when(legal, F.lit(lat_err)),
        F.when(legal, F.lit(lon_err)),
    )
