"""Text columns: punctuation, case, and the three ways of splitting."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Unicode and ASCII count as white space, the separators FS, GS, RS and US among them.
#: The ranges before && hold all of them; letters fail there, which halves the time of a split.
WHITESPACE = r"[\x09-\x20\x85\x{a0}\x{1680}-\x{3000}&&[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]+"


def strip_punctuation(text: Column) -> Column:
    """The text without ASCII punctuation; null stays null."""
    return F.translate(text, string.punctuation, "")


def split(text: Column, separator: str | None = None) -> Column:
    """Parts of a text, null for null.

    Without a separator the text is cut at white space and no part is empty;
    with one, empty parts stay; the empty separator gives single characters
    (one empty part for an empty text).
    """
    if separator is None:
        return F.array_remove(F.split(text, WHITESPACE), "")
    if separator == "":
        return F.split(text, "")
    quoted = re.sub(r"([^\w\s])", r"\\\1", separator)
    return F.split(text, quoted, -1)


def words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation."""
    return split(F.lower(strip_punctuation(text)))
