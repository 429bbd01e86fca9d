"""Who won, from whose point of view, and which pair met."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.text import mentions

NO_RESULT = "No Result"


def outcome_label(winner: Column, side1: Column, side2: Column) -> Column:
    """1 when side 1 won, 0 when side 2 won, NULL otherwise."""
    return F.when(winner == side1, F.lit(1)).when(winner == side2, F.lit(0))


def winner_name(winner: Column, side1: Column, side2: Column, name1: Column, name2: Column) -> Column:
    return F.when(winner == side1, name1).when(winner == side2, name2).otherwise(F.lit(NO_RESULT))


def same_pair(side1: Column, side2: Column, one: str, other: str) -> Column:
    """True when the two sides are ``one`` and ``other``, in either order."""
    return ((side1 == one) & (side2 == other)) | ((side1 == other) & (side2 == one))


def neutral_flag(venue: Column, side1: Column, side2: Column) -> Column:
    """1 unless the venue's name contains the name of one of the sides."""
    return F.when(mentions(venue, side1) | mentions(venue, side2), F.lit(0)).otherwise(F.lit(1))
