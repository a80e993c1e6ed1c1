"""Column expressions: everything here stays inside generated JVM code."""

from kerbstone.functions.arithmetic import age, recency, row_total
from kerbstone.functions.codes import (
    LAND_USE,
    RISK_BANDS,
    band_color,
    band_label,
    land_use_category,
)
from kerbstone.functions.geo import geohash, miles_from_origin
from kerbstone.functions.text import (
    lenient_number,
    lenient_timestamp,
    normalise_key,
    plain_number_text,
    strict_timestamp,
    year_of,
)

__all__ = [
    "LAND_USE",
    "RISK_BANDS",
    "age",
    "band_color",
    "band_label",
    "geohash",
    "land_use_category",
    "lenient_number",
    "lenient_timestamp",
    "miles_from_origin",
    "normalise_key",
    "plain_number_text",
    "recency",
    "row_total",
    "strict_timestamp",
    "year_of",
]
