"""Small functions needed both as Columns and in plain Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_CHARS = 500


def error_text(message: str | None) -> str:
    """An error's text, shortened; without one 'unknown error'."""
    return "unknown error" if message is None else message[:ERROR_CHARS]


def error_column(message: Column) -> Column:
    return F.coalesce(F.substring(message, 1, ERROR_CHARS), F.lit("unknown error"))
