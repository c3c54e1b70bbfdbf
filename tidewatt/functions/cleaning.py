"""Text to numbers and times, with null for what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing number, and the number patterns.
MISSING_TEXTS = ["", "NA", "N/A", "nan", "None"]
PLAIN_PATTERN = r"^(?i)[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|inf(inity)?)$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
NUMBER_PATTERN = r"([-+]?\d*\.?\d+)"


def plain_number(text: Column) -> Column:
    """Strict coercion: the whole text is a number or the result is null.

    The cast alone would also take Java literals such as ``1d`` and ``0x1p3``.
    """
    bare = F.trim(text)
    return F.when(bare.rlike(PLAIN_PATTERN), bare.try_cast("double"))


def dirty_number(text: Column) -> Column:
    """First number in a decorated text such as ``" 4.5* "`` or ``1,5``."""
    bare = F.btrim(F.btrim(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), F.lit('"')), F.lit("'"))
    # U+2212 is a minus sign; U+00A0 and U+200B are invisible
    bare = F.translate(bare, "\u2212,\u00a0\u200b", "-.")
    number = F.regexp_extract(bare, NUMBER_PATTERN, 1)
    return F.when(~bare.isin(MISSING_TEXTS), number.try_cast("double"))


def readable_time(text: Column) -> Column:
    """``yyyy-MM-dd`` with an optional time of day, else null; independent of the session zone."""
    bare = F.trim(text)
    return F.when(bare.rlike(DATE_PATTERN), bare.try_cast("timestamp_ntz"))


def known_or_error(name: str) -> Column:
    """The column, which must be known: a null fails the job that reads it."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"no value of {name}")).cast("double"))


def nan_as_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere downstream; turn it into null once, on reading."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_as_null(F.col(c)) for c in floats}) if floats else df
