"""Text keys."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def report_key(text) -> Column:
    """Lower-case text without non-word characters; NULL reads as the text 'nan'."""
    whole = F.coalesce(col(text).cast("string"), F.lit("nan"))
    return F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}_]+", "")


def words(text) -> Column:
    tokens = F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(tokens, lambda w: w != "")
