"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketscope.config import NULL_TOKENS

# Every character that counts as white space at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes blanks only).

    Most cells have none; looking at the first and last character is cheaper than ``btrim`` with
    a character set.
    """
    characters = F.lit(WHITESPACE)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    padded = characters.contains(first) | characters.contains(last)
    return F.when(padded, F.btrim(text, characters)).otherwise(text)


def null_tokens_to_null(text: Column) -> Column:
    """Turn the cells that stand for "missing" into NULL."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def blank_if_missing(stripped: Column) -> Column:
    """Missing cells and the word ``nan`` become the empty string."""
    return F.when(stripped != "nan", stripped).otherwise(F.lit(""))
