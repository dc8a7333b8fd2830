"""Per-stay running operators over a daily panel.

A panel has one row per stay and day, so each window group has at most as many
rows as there are day bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_exposure_rows(
    panel: DataFrame, exposure: str, id: str, time: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows up to and including the first exposed one of each stay."""
    earlier = (
        Window.partitionBy(*by, id).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.coalesce(F.max(F.col(exposure).cast("int")).over(earlier), F.lit(0))
    return panel.withColumn("_seen", seen).filter(F.col("_seen") == 0).drop("_seen")


def cumulative_product(value: Column | str, id: str, time: str, by: Sequence[str] = ()) -> Column:
    """Product of ``value`` over the rows of the stay up to this one."""
    so_far = Window.partitionBy(*by, id).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(value).over(so_far)


def exposed_from(exposure: Column, value: Column, id: str, time: str) -> Column:
    """Smallest cut-off at which the stay already had an exposed row before this one.

    Sub-populations are nested (``value <= cutoff``), so a row belongs to the rows
    "up to and including the first exposure" of a cut-off c exactly when
    ``value <= c < exposed_from``.  One window serves all cut-offs.
    """
    earlier = Window.partitionBy(id).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.min(F.when(exposure, value)).over(earlier), F.lit(float("inf")))
