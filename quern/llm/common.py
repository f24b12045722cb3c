"""Shared pieces of the corpus operators: size-checked restriction, word patterns, bound values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import fresh, let
from ..sources.scratch import Stored, fresh_path, shared_dir

__all__ = ["SPACES", "SPACE_CLASS", "Stored", "fresh", "fresh_path", "let", "restrict", "shared_dir", "words_of"]

#: A word is a maximal run of characters outside ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: A set of ids is broadcast only up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def restrict(df: DataFrame, ids: DataFrame, key: str, max_rows: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (a stored one-column table): a map-side filter while the counted ids
    stay under ``max_rows``, a shuffled semi join beyond that."""
    few = ids.count() <= max_rows
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), key, "left_semi")


def words_of(text: Column) -> Column:
    """Array of words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")
