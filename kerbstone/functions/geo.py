"""Distances and geohashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in miles, and the geohash digit alphabet.
EARTH_MILES = 3956.0
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def miles_from_origin(lat: Column, lon: Column, degrees: bool = True) -> Column:
    """Great-circle miles from latitude 0, longitude 0, rounded to 7 places."""
    if degrees:
        lat, lon = F.radians(lat), F.radians(lon)
    half_lat, half_lon = F.sin(lat / 2), F.sin(lon / 2)
    chord = half_lat * half_lat + F.cos(lat) * half_lon * half_lon
    return F.round(F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(chord)), 7)


def _cell(share: Column, bits: int) -> Column:
    """Index of the cell ``share`` (0 to 1) falls in; the upper edge belongs to the last one."""
    return F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1))


# Digit by the bits of the leading coordinate (3) and of the other one (2), which alternate.
_BY_BITS = "".join(
    GEOHASH_DIGITS[
        (lead & 4) << 2 | (other & 2) << 2 | (lead & 2) << 1 | (other & 1) << 1 | lead & 1
    ]
    for lead in range(8)
    for other in range(4)
)


def geohash(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Geohash text of a point; longitudes beyond ±180 wrap, bad latitudes give null.

    A digit takes the next three bits of one coordinate and the next two of the
    other, longitude leading in the first digit and latitude in the second.
    """
    lon_left, lat_left = (5 * precision + 1) // 2, 5 * precision // 2
    around = F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)
    lon_cell = _cell((around + 180) / 360, lon_left)
    lat_cell = _cell((lat + 90) / 180, lat_left)

    digits = []
    for number in range(precision):
        lon_bits, lat_bits = (3, 2) if number % 2 == 0 else (2, 3)
        lon_left, lat_left = lon_left - lon_bits, lat_left - lat_bits
        by_lon = F.shiftright(lon_cell, lon_left).bitwiseAND(F.lit((1 << lon_bits) - 1))
        by_lat = F.shiftright(lat_cell, lat_left).bitwiseAND(F.lit((1 << lat_bits) - 1))
        lead, other = (by_lon, by_lat) if number % 2 == 0 else (by_lat, by_lon)
        place = (lead * 4 + other + 1).cast("int")
        digits.append(F.substring(F.lit(_BY_BITS), place, F.lit(1)))
    return F.when(lat.between(-90, 90), F.concat(*digits))
