"""Infusion volumes from interval records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hours_between, na_ifelse

# Units and order categories as they occur in the records.
VOLUME_RATE_UNITS = ["mL/min", "mL/hour"]
PER_MINUTE = "mL/min"
LITRE = "L"
CONTINUOUS = ["Continuous Med", "Continuous IV"]


def infusion_volume() -> Column:
    """Volume in mL of one record.

    Continuous orders count rate times duration, all others their amount.  The
    whole volume belongs to the start of the record.  Unknown unit, category or
    end give NULL.
    """
    amount = na_ifelse(F.col("amountuom") == LITRE, F.col("amount") * 1000, F.col("amount"))
    rate = na_ifelse(F.col("rateuom") == PER_MINUTE, F.col("rate") * 60, F.col("rate"))
    return na_ifelse(
        F.col("ordercategorydescription").isin(CONTINUOUS),
        rate * hours_between("starttime", "endtime"),
        amount,
    )
