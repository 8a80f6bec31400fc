"""What every text embedder offers."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Embedder(Protocol):
    def embed(self, texts: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """texts with a vector column."""

    @property
    def dims(self) -> int:
        """Length of the vectors; 0 while unknown."""
