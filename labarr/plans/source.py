"""Where cells come from. A source yields long rows: one per cell, with its positions.

``read`` is told which positions are wanted and prunes what it can; it may return more,
as the array filters exactly on top.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .picks import Pick, covers, hull, wanted

#: Prefix of position columns.
I = "__i_"  # noqa: E741
#: Longest list of positions that is written into a filter; more go through a join.
LISTED = 512


def position(dim: str) -> str:
    return I + dim


def within(df: DataFrame, dim: str, pick: Pick) -> DataFrame:
    """Rows at the picked positions, by a filter that reaches a columnar scan."""
    c, span = F.col(f"`{position(dim)}`"), hull(pick)
    if isinstance(pick, int):
        return df.filter(c == pick)
    df = df.filter(c.between(span.start, span.stop - 1)) if len(span) else df.filter(F.lit(False))
    if isinstance(pick, range):
        return df.filter(F.pmod(c - span.start, F.lit(abs(pick.step))) == 0) if abs(pick.step) > 1 else df
    at = wanted(pick)
    return df.filter(c.isin([int(x) for x in at])) if len(at) <= LISTED and len(at) < len(span) else df


class Source(ABC):
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: S.DataType
    spark: SparkSession

    @abstractmethod
    def read(self, picks: dict[str, Pick]) -> DataFrame:
        """Position columns of all dimensions and ``value``."""


class FrameSource(Source):
    """A value expression over a DataFrame with position columns.

    Variables over one frame share its scan: operations between them become one
    projection, without a join. A frame may also be an object that plans itself for the
    wanted positions, by ``narrowed(picks)``.
    """

    def __init__(self, frame, dims: tuple[str, ...], shape: tuple[int, ...], value: Column | str = "value", dtype: S.DataType | None = None):
        self.frame, self.dims, self.shape, self.spark = frame, tuple(dims), tuple(shape), frame.sparkSession
        self.value = F.col(value) if isinstance(value, str) else value
        self.dtype = dtype or frame.select(self.value.alias("value")).schema["value"].dataType

    def narrowed(self, picks: dict[str, Pick]) -> DataFrame:
        if not isinstance(self.frame, DataFrame):
            return self.frame.narrowed(picks)
        df = self.frame
        for d, n in zip(self.dims, self.shape, strict=True):
            if d in picks and not covers(picks[d], n):
                df = within(df, d, picks[d])
        return df

    def read(self, picks: dict[str, Pick]) -> DataFrame:
        return self.narrowed(picks).select(*(F.col(f"`{position(d)}`") for d in self.dims), self.value.alias("value"))

    def with_value(self, value: Column, dtype: S.DataType) -> FrameSource:
        return FrameSource(self.frame, self.dims, self.shape, value, dtype)


def mapping(spark: SparkSession, pick: np.ndarray, old: str, new: str) -> DataFrame:
    """(old, new) positions of a pick: a driver-side list, so its size is known."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({old: np.asarray(pick, np.int64), new: np.arange(len(pick), dtype=np.int64)}))
