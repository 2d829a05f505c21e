"""A bounded history: newest entries first, a cap, deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 60


def latest(events: DataFrame, owner: str, ts: str, id_col: str, cap: int = CAP) -> DataFrame:
    """Each owner's last ``cap`` entries with ``place``, newest first; ties go to the larger id, entries without a time go last."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc_nulls_last(ts), F.desc(id_col)))
    return events.withColumn("place", place).where(F.col("place") <= cap)


def delete(events: DataFrame, id_col: str, ids: Sequence[int]) -> DataFrame:
    return events.where(~F.col(id_col).isin(list(ids)))


def clear(events: DataFrame) -> DataFrame:
    return events.limit(0)
