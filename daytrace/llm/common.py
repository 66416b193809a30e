"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, new_folder, shared_dir

__all__ = ["LOWER", "UPPER", "ascii_lower", "cut_lineage", "documents", "new_folder", "rows_of", "shared_dir"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(batch, columns: list[str], size: int = 256):
    """Slices of an Arrow batch as tuples of Python lists, so that few texts are Python objects at a time."""
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        yield tuple(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)
