"""Day spine and panel assembly."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MAX_DAYS


def day_spine(cohort: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """One row per stay and started day, at most ``max_days`` of them."""
    last = F.least(F.ceil("los_icu").cast("int"), F.lit(max_days))
    return cohort.filter(F.col("los_icu") > 0).select(
        "stay_id", F.explode(F.sequence(F.lit(1), last)).alias("day")
    )


def assemble_panel(spine: DataFrame, daily: Iterable[DataFrame]) -> DataFrame:
    """Left-join every daily table to the spine on (stay, day).

    Each daily table comes out of an aggregate on the same two keys, so the joins
    reuse its partitioning and add no shuffle of their own.
    """
    panel = spine
    for features in daily:
        panel = panel.join(features, ["stay_id", "day"], "left")
    return panel


def counting_process(panel: DataFrame) -> DataFrame:
    """Add the interval ``(tstart, tstop]`` of each day and the fluid balance ``fb``."""
    return panel.withColumns(
        {
            "tstart": F.col("day") - 1,
            "tstop": F.col("day"),
            "fb": F.coalesce("input_total", F.lit(0.0)) - F.coalesce("output_total", F.lit(0.0)),
        }
    )
