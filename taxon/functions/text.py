"""String expressions on item columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white space that stripping removes at both ends and that separates words.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

ENTITY_ID = r"Q\d+"
KNOWLEDGE_HOST = "wikidata.org"


def filled(c: Column) -> Column:
    """Value as a string, missing as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def entity_id_by_pattern(uri: Column) -> Column:
    """First ``Q<digits>`` in the URI, NULL when there is none."""
    return F.nullif(F.regexp_extract(uri, ENTITY_ID, 0), F.lit(""))


def entity_id_by_tail(uri: Column) -> Column:
    """Last path part of a URI on the knowledge-base host, else NULL."""
    return F.when(uri.contains(KNOWLEDGE_HOST), F.substring_index(uri, "/", -1))


def word_count(c: Column) -> Column:
    """Number of white-space separated words; empty and NULL text have none."""
    # splitting at single characters and dropping the empty parts beats matching runs
    return F.coalesce(F.size(F.array_remove(F.split(c.cast("string"), f"[{WHITESPACE}]"), "")), F.lit(0))


def truncated(c: Column, length: int = 500) -> Column:
    return F.substring(c, 1, length)


def with_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: filled(F.col(c)) for c in columns})


def with_stripped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns})


def with_text_lengths(df: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """Character and word counts of the two text columns."""
    return df.withColumns(
        {
            "name_length": F.length(filled(F.col(name))),
            "desc_length": F.length(filled(F.col(description))),
            "name_word_count": word_count(F.col(name)),
            "desc_word_count": word_count(F.col(description)),
        }
    )
