"""Training and held-out rows, told apart by the checksum of their id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 1 for a null id, which thus never is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(1))
