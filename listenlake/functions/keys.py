"""Canonical keys and small string functions, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text(value: Column) -> Column:
    """A trimmed string; null becomes empty. All white space counts, not only blanks."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def filled(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value, F.lit(""))


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    """Full case folding, for names where lower() differs from it."""
    return values.str.casefold()


#: What full case folding does beyond lower(): letters that are lower case already and fold further, such as the sharp s.
_FURTHER = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold()}


def folded(value: Column) -> Column:
    """Full case folding inside the JVM: plain ASCII is lower-cased, and only other names are taken letter by letter."""
    further = F.create_map(*(F.lit(x) for pair in _FURTHER.items() for x in pair))
    letters = F.regexp_extract_all(F.lower(value), F.lit("(?s)."), F.lit(0))
    return F.when(value.rlike(r"^\p{ASCII}*$"), F.lower(value)).otherwise(F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(further, c), c)), ""))


def track_id(spotify_id: Column, isrc: Column, mbid: Column, name: Column, artist: Column, fold=folded) -> Column:
    """The strongest identity of a track; empty strings fall through."""
    return F.coalesce(
        F.concat(F.lit("mbid:"), filled(mbid)),
        F.concat(F.lit("isrc:"), filled(isrc)),
        F.concat(F.lit("spotify:"), filled(spotify_id)),
        F.concat(F.lit("name:"), fold(F.coalesce(name, F.lit(""))), F.lit("\x1f"), fold(F.coalesce(artist, F.lit("")))),
    )


def artist_key(uri: Column, name: Column, fold=folded) -> Column:
    return F.coalesce(F.concat(F.lit("uri:"), filled(uri)), F.concat(F.lit("name:"), fold(name)))


def library_artist_key(uri: Column, name: Column, fold=folded) -> Column:
    return F.coalesce(filled(uri), fold(name))


def uri_tail(uri: Column, prefix: str = "spotify:track:") -> Column:
    return F.when(uri.startswith(prefix), filled(uri.substr(F.lit(len(prefix) + 1), F.length(uri))))


def bare_spotify_id(value: Column) -> Column:
    return F.regexp_replace(value, "^spotify:track:", "")


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_")


def quoted(value: Column) -> Column:
    """Percent encoding with nothing left safe but letters, digits and -._~."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def band(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "low").when(value < high, "mid").otherwise("high")


def half_even(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even; ``round`` takes the shortest decimal and ties away from zero."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
