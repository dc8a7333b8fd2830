"""Diagnosis flags per admission and the site class derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codebook import CATEGORIES, default_codebook
from .joins import is_small

OTHER_SITE = 4


def code_flags(
    diagnoses: DataFrame,
    codebook: DataFrame | None = None,
    categories: Sequence[str] = tuple(CATEGORIES),
    keys: Sequence[str] = ("subject_id", "hadm_id"),
    repaired: bool = False,
) -> DataFrame:
    """0/1 flag per category for every admission that has a diagnosis row.

    Each code looks up one integer whose bits are its categories; admissions
    combine them with a bitwise OR, so the shuffle carries one integer per
    admission and task.  A codebook too large to be broadcast is joined by a shuffle.
    Codes that a codebook marks as not ``as_written`` count only if ``repaired``.
    """
    if codebook is None:
        codebook = default_codebook(diagnoses.sparkSession)
        broadcast = True
    else:
        broadcast = is_small(codebook)
    if not repaired and "as_written" in codebook.columns:
        codebook = codebook.filter("as_written")
    bits = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, 1 << i)])
    masks = (
        codebook.filter(F.col("category").isin(list(categories)))
        .groupBy("icd_version", "icd_code")
        .agg(F.bit_or(bits[F.col("category")]).alias("_mask"))
    )
    hits = (
        diagnoses.select(*keys, "icd_version", "icd_code")
        .join(F.broadcast(masks) if broadcast else masks, ["icd_version", "icd_code"], "left")
        .groupBy(*keys)
        .agg(F.coalesce(F.bit_or("_mask"), F.lit(0)).alias("_mask"))
    )
    return hits.select(
        *keys,
        *[
            F.shiftright("_mask", i).bitwiseAND(F.lit(1)).alias(c)
            for i, c in enumerate(categories)
        ],
    )


def attach_flags(
    cohort: DataFrame,
    flags: DataFrame,
    categories: Sequence[str] = tuple(CATEGORIES),
    key: str = "hadm_id",
) -> DataFrame:
    """Cohort columns plus flags; stays without any diagnosis row get NULL flags."""
    c, f = cohort.alias("c"), flags.alias("f")
    return c.join(f, F.col(f"c.{key}") == F.col(f"f.{key}"), "left").select(
        "c.*", *[F.col(f"f.{name}") for name in categories]
    )


def site_class(flags: DataFrame) -> DataFrame:
    """Add ``infectionsite``: the first flag that is set decides, missing flags give 4."""
    first = (
        F.when(F.col("lung_infection") == 1, 1)
        .when(F.col("Peritoneal_infection") == 1, 2)
        .when(F.col("Gastrointestinal_infection") == 1, 2)
        .when(F.col("Genitourinary_infection") == 1, 3)
    )
    return flags.withColumn("infectionsite", F.coalesce(first, F.lit(OTHER_SITE)))
