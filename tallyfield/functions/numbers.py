"""Numbers and dates out of text, and ratios that neither fail nor drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.text import strip

# What counts as a number. Spark's own cast would also take "1.0d", "inf" and "nan".
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Date spellings that occur in match tables, tried in this order.
DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy")


def to_number(text: Column) -> Column:
    """Double, or NULL where the text is no number; white space of any kind around it does not matter."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def to_whole(text: Column, default: int = 0) -> Column:
    """Integer part of a numeric text as a long; ``default`` where there is none."""
    return F.coalesce(to_number(text).try_cast("long"), F.lit(default).cast("long"))


def to_date_any(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits wins, white space at the ends left out; NULL where none does."""
    return F.coalesce(*[F.try_to_date(strip(text), pattern) for pattern in formats])


def iso_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.date_format(to_date_any(text, formats), "yyyy-MM-dd")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; NULL over zero or NULL."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def rounded_ratio(top: Column, bottom: Column, scale: int = 1, places: int = 2, digits: int = 0) -> Column:
    """``scale * top / bottom`` rounded half away from zero to ``places``; operands have up to ``digits`` decimals.

    Rounding happens on integers, so the result does not depend on how a double happens to be stored.
    """
    unit = 10**places
    whole = lambda c: (c.cast(f"decimal({20 + digits},{digits})") * F.lit(10**digits)).cast("decimal(24,0)")
    top, bottom = whole(top), F.nullif(whole(bottom), F.lit(0))
    sign = F.signum(top) * F.signum(bottom)
    top, bottom = F.abs(top), F.abs(bottom)
    steps = F.call_function("div", top * F.lit(2 * scale * unit) + bottom, bottom * F.lit(2))
    return F.when(steps == 0, F.lit(0.0)).otherwise(steps.cast("double") * sign / F.lit(float(unit)))


def overs_to_balls(overs: Column, balls_per_over: int = 6) -> Column:
    """Overs such as 3.4 mean three overs and four balls."""
    tenths = F.round(overs * 10).cast("long")
    return F.floor(tenths / 10) * balls_per_over + tenths % 10
