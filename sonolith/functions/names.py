"""Names of songs: comparable keys, sequence likeness and what titles and albums say (live, clean, bonus discs)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that decide what counts as a word, a live recording, or a parenthetical remark.
WORDS = r"([^\W]+|[^\s]+)"
LIVE = r"(?i)(live\s+in|.+?\blive\s*$)"
REMARK = (
    r"(?i)([\[(]\s*.*?(bootleg|(?:bonus\s+)?cd[0-9]*|clean(?:\s+edit)?|"
    r"(?:bonus\s+)?dis[ckq]u?e?\s*[a-z0-9-]*|ep(?:\s+single))|"
    r"edit(?:ed|ion)?|live|(?:bonus\s+)?track?\s*(?:[a-z0-9-]+|edition)?|"
    r"(?:cd|ep\s+)?single(:?\s+track?)?|"
    r"v(?:(?:ol(?:\.|ume)?\s*[a-z0-9]*|ersi?o?n?)|vinyl)\s*[\])])"
)
DISC = r"(?i)((?:dis[ckq]u?e?|track?)\s*[a-z0-9-]+)"


def joined_words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(WORDS), F.lit(1)), "")


def name_key(artist: Column, title: Column) -> Column:
    """All words of artist and title in lower case, without what separates them."""
    return F.lower(F.concat(joined_words(artist), joined_words(title)))


def display_name(artist: Column, title: Column) -> Column:
    return F.concat(artist, F.lit("_"), title)


def is_live(text: Column) -> Column:
    return text.rlike(LIVE)


def clean_remark(text: Column) -> Column:
    """Struct (clean, remark): whether the first parenthetical remark says `clean`, and what it says then."""
    clean = F.regexp_extract(text, REMARK, 1).contains("clean")
    return F.struct(clean.alias("clean"), F.when(clean, F.regexp_extract(text, REMARK, 2)).otherwise("").alias("remark"))


def disc(text: Column) -> Column:
    return F.regexp_extract(text, DISC, 1)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by their longest common blocks; null if one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
