"""All pairs of blocks, without a shuffle of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meetings(own: DataFrame, others: DataFrame, at: Sequence[str], near: Column | None = None) -> DataFrame:
    """Every row of ``own`` (columns as ``l_``) beside every row of ``others`` (as ``r_``), or those that ``near`` lets through.

    Both come from written tables of blocks, one row of ``own`` per value of ``at``.  A task holds one of them and reads the
    others one after the other from where they are written, so what is found about a block is complete when its task ends.
    Neither pairs nor partial results travel or touch a disk, however many blocks there are; a block moves once.
    """
    mine = own.repartitionByRange(max(1, own.count()), *at).select([F.col(c).alias(f"l_{c}") for c in own.columns])
    every = others.select([F.col(c).alias(f"r_{c}") for c in others.columns]).coalesce(1).hint("shuffle_replicate_nl")
    return every.crossJoin(mine) if near is None else every.join(mine, near)
