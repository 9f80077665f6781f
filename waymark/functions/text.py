"""Standard forms of names and the places that an address names, as columns.

Null counts as empty. White space is trimmed in all its forms, not blanks alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NOISE, LinkConfig


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"^\s+|\s+$", "")


def standard(c: Column | str) -> Column:
    """Trimmed and in capitals."""
    return F.upper(trimmed(c))


def without_noise(c: Column | str) -> Column:
    """At most one noise word less at the start, then at the end, where white space sets it off."""
    out = F.regexp_replace(standard(c), rf"^({NOISE})\s+", "")
    return trimmed(F.regexp_replace(out, rf"\s+({NOISE})$", ""))


def normal(c: Column | str) -> Column:
    """Without noise, hyphens as blanks, runs of white space as one."""
    return trimmed(F.regexp_replace(F.regexp_replace(without_noise(c), "-", " "), r"\s+", " "))


def letters(address: Column | str) -> Column:
    """What of an address its places depend on: capitals, and what parts its segments; all else is a blank. Addresses with the same letters name the same places."""
    text = F.upper(F.coalesce(F.col(address) if isinstance(address, str) else address, F.lit("")))
    return F.regexp_replace(text, r"[^A-Z,\n;|/]+", " ")


def _places(config: LinkConfig) -> Callable[[str], list[str]]:
    stop, least = frozenset(config.stopwords), config.min_letters

    @lru_cache(maxsize=1 << 14)
    def candidates(segment: str) -> tuple[str, ...]:
        words = [w for w in segment.split(" ") if w and w not in stop]
        return tuple(w for w in (" ".join(words), *words) if len(w) - w.count(" ") >= least)

    return lambda text: list(dict.fromkeys(p for segment in re.split(r"[,\n;|/]+", text) for p in candidates(segment)))


def localities(address: Column | str, config: LinkConfig = LinkConfig()) -> Column:
    """Candidate places of an address: of each segment its words of capitals that are no stopwords together, then each word; distinct, in order, long enough."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _places(config)
        for texts in batches:
            yield pa.array([places(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return found(letters(address))


def is_blank(c: Column | str) -> Column:
    return F.length(trimmed(c)) == 0
