"""Code-to-category mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-use code ranges, both ends included.
LAND_USE = {
    "SINGLE OR TWO RESIDENTIAL": [(11, 13)],
    "MULTIFAMILY": [(21, 25)],
    "OFFICE AND PUBLIC SERVICE": [(31, 38)],
    "INSTITUTIONAL": [(40, 49)],
    "COMMERCIAL": [(51, 53)],
    "INDUSTRIAL": [(61, 61), (63, 69)],
    "AIRPORT": [(62, 62)],
    "OPEN SPACES/NA": [(70, 97), (0, 8)],
}

# Lowest score of each band, its colour and its name, in test order.
RISK_BANDS = [(0.6, "red", "high"), (0.4, "yellow", "mid"), (0.0, "green", "low")]


def land_use_category(code: Column) -> Column:
    """Category of a numeric land-use code; a code without one stays, as text."""
    whole = code == F.floor(code)
    branches = F
    for category, ranges in LAND_USE.items():
        for low, high in ranges:
            branches = branches.when(whole & code.between(low, high), category)
    return branches.when(whole, code.cast("bigint").cast("string")).otherwise(code.cast("string"))


def _band(score: Column, position: int) -> Column:
    branches = F
    for band in RISK_BANDS:
        branches = branches.when(score >= band[0], band[position])
    return branches


def band_color(score: Column) -> Column:
    """Colour of the first band whose lowest score is reached; null below all bands."""
    return _band(score, 1)


def band_label(score: Column) -> Column:
    return _band(score, 2)
