"""Exclusion of known keys with the meaning of NOT IN, without broadcasting the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import VaultConfig
from .hwm import TargetFacts


def not_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't among ``keys``: none if a key there is NULL; a NULL of the rows stays only if there are no keys."""
    return TargetFacts(keys, VaultConfig(), key=column).not_known(rows, column)
