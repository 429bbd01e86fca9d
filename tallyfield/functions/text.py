"""Text columns: stripping, scrubbing, missing-value tokens, visible text of HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residue that name columns of the source data carry.
NAME_RESIDUE = ("â€", "†", "\u00a0")

# Entities that occur in page text, with what they stand for. The ampersand comes last so that
# "&amp;lt;" becomes "&lt;" and no further.
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&dagger;", "†"),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)


# Every character that counts as white space; all of them lie below U+3001.
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends; Spark's plain ``trim`` knows the ordinary space only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def scrub(text: Column, residue: Sequence[str] = NAME_RESIDUE) -> Column:
    """Delete every occurrence of the given character sequences."""
    for piece in residue:
        text = F.replace(text, F.lit(piece), F.lit(""))
    return text


def null_if_token(text: Column, tokens: Sequence[str] = ("", "nan")) -> Column:
    """Turn texts that stand for a missing value into NULL."""
    return F.when(~text.isin(*tokens), text)


def fold_category(text: Column) -> Column:
    """One spelling per category: stripped and lower case."""
    return F.lower(strip(text))


def present_flag(text: Column, present: str, absent: str) -> Column:
    """``present`` where the text has characters, ``absent`` where it is empty, NULL where it is NULL."""
    return F.when(F.length(text) > 0, F.lit(present)).when(F.length(text) == 0, F.lit(absent))


def mentions(haystack: Column, needle: Column) -> Column:
    """Case-insensitive substring test that reads a missing haystack as empty text."""
    return F.lower(F.coalesce(haystack, F.lit(""))).contains(F.lower(needle))


def visible_text(markup: Column) -> Column:
    """Text of an HTML fragment: tags out, entities resolved, spacing kept."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text
