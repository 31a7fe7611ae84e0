"""Projections: constants, exclusion, renaming, fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(frame: DataFrame, constants: Mapping[str, float | int | str]) -> DataFrame:
    """Design parameters as constant columns."""
    return frame.withColumns({k: F.lit(v) for k, v in constants.items()})


def reshape(frame: DataFrame, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None, replace: Mapping[str, Column] | None = None) -> DataFrame:
    """Drop (absent names are fine), rename, then replace or add columns."""
    out = frame.drop(*drop).withColumnsRenamed(dict(rename or {}))
    return out.withColumns(dict(replace or {}))


def ordered_subset(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns that exist, in that order, each once."""
    return frame.select(*[c for c in dict.fromkeys(columns) if c in frame.columns])
