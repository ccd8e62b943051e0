"""Dates of samples and reports as written in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notations in the order in which they are tried (month before day where both fit).
NOTATIONS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def sample_date(text: Column) -> Column:
    """ISO with or without a time, then the notations; null if none fits."""
    iso = F.when(text.rlike(_ISO), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(n)) for n in NOTATIONS])


def report_date(text: Column) -> Column:
    """The notations without a time, then a year alone; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(n)) for n in (*NOTATIONS, "yyyy")])
