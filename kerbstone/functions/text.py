"""Text clean-up and text-to-value parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_key(text: Column) -> Column:
    """Upper-case and remove every ASCII space; tabs and other blanks stay."""
    return F.replace(F.upper(text), F.lit(" "), F.lit(""))


def lenient_number(text: Column) -> Column:
    """Number in ``text`` as double; null where it is not a number.

    The JVM also accepts a type suffix (``12d``, ``3.f``) and ``NaN``; neither is a number here.
    """
    suffixed = text.cast("string").rlike(r"[0-9.][dDfF]\s*$")
    number = F.when(~suffixed, text.cast("string").try_cast("double"))
    return F.when(~F.isnan(number), number)


def lenient_timestamp(text: Column, *formats: str) -> Column:
    """Timestamp in ``text``, trying each format in order; null where none fits.

    ISO text with fractions or a zone is read last; the zone is dropped, so the wall time
    stays as written whatever the session's zone.
    """
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), text)
    return F.coalesce(*tried, iso.try_cast("timestamp_ntz"))


def strict_timestamp(text: Column, *formats: str) -> Column:
    """Like :func:`lenient_timestamp`, but unreadable text stops the query."""
    problem = F.raise_error(F.concat(F.lit("not a timestamp: "), text.cast("string")))
    return F.coalesce(
        lenient_timestamp(text, *formats),
        F.when(text.isNotNull(), problem.cast("timestamp_ntz")),
    )


def year_of(timestamp: Column) -> Column:
    return F.year(timestamp)


def plain_number_text(number: Column) -> Column:
    """A double as plain decimal text (``0.0005``, ``1.0``), never with an exponent."""
    return F.regexp_replace(number.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
