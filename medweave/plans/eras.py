"""Condition and drug eras."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from medweave.operators.ids import assign_ids
from medweave.operators.intervals import condition_end, drug_end, merge_intervals
from medweave.operators.skew import skew_join

GAP_DAYS = 30


def condition_era(occurrence: DataFrame, gap: int = GAP_DAYS, strict: bool = False) -> DataFrame:
    """Eras of condition occurrences per person and concept."""
    spans = occurrence.select(
        "person_id", "condition_concept_id", "condition_start_date",
        condition_end(F.col("condition_start_date"), F.col("condition_end_date")).alias("end"),
    )
    merged = merge_intervals(spans, ["person_id", "condition_concept_id"], "condition_start_date", "end", gap, strict)
    return merged.select(
        "person_id", "condition_concept_id", F.col("era_start").alias("condition_era_start_date"),
        F.col("era_end").alias("condition_era_end_date"), F.col("n").alias("condition_occurrence_count"),
    )


def drug_era_eligible(exposure: DataFrame, concept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exposures with a mapped drug and a supply of zero days or more, and the ingredient concepts."""
    exposures = exposure.where((F.col("drug_concept_id") != 0) & (F.col("days_supply") >= 0))
    ingredients = concept.where((F.col("vocabulary_id") == "RxNorm") & (F.col("concept_class_id") == "Ingredient"))
    return exposures, ingredients.select("concept_id").distinct()


def ingredient_rollup(exposure: DataFrame, ancestor: DataFrame, concept: DataFrame) -> DataFrame:
    """Eligible exposures, one row per ingredient of the drug."""
    exposures, ingredients = drug_era_eligible(exposure, concept)
    parts = ancestor.join(ingredients, ancestor["ancestor_concept_id"] == ingredients["concept_id"], "left_semi")
    parts = parts.select(
        F.col("descendant_concept_id").alias("drug_concept_id"), F.col("ancestor_concept_id").alias("ingredient_concept_id")
    ).distinct()
    return skew_join(exposures, parts, ["drug_concept_id"], "inner")


def drug_era(exposure: DataFrame, ancestor: DataFrame, concept: DataFrame, gap: int = GAP_DAYS, strict: bool = False) -> DataFrame:
    """Eras of exposures per person and ingredient.

    Overlapping exposures become one sub-exposure first; eras are made of those, so that
    ``gap_days`` counts only the days between them.
    """
    keys = ["person_id", "ingredient_concept_id"]
    rolled = ingredient_rollup(exposure, ancestor, concept).select(
        *keys, F.col("drug_exposure_start_date").alias("start"),
        drug_end(F.col("drug_exposure_start_date"), F.col("drug_exposure_end_date"), F.col("days_supply").cast("int")).alias("end"),
    )
    sub = merge_intervals(rolled, keys, "start", "end", 0, strict).withColumn("exposed", F.datediff("era_end", "era_start"))
    sub = sub.select(*keys, F.col("era_start").alias("start"), F.col("era_end").alias("end"), F.col("n").alias("exposures"), "exposed")
    eras = merge_intervals(sub, keys, "start", "end", gap, count="exposures", measures={"exposed": "exposed"}, unique_starts=True)
    return eras.select(
        "person_id", F.col("ingredient_concept_id").alias("drug_concept_id"), F.col("era_start").alias("drug_era_start_date"),
        F.col("era_end").alias("drug_era_end_date"), F.col("n").alias("drug_exposure_count"),
        (F.datediff("era_end", "era_start") - F.col("exposed")).cast("long").alias("gap_days"),
    )


def number_eras(eras: DataFrame, id_col: str, base: int = 1) -> DataFrame:
    """Era ids in order of person, concept and start."""
    concept, start = (next(c for c in eras.columns if c.endswith(e)) for e in ("_concept_id", "_start_date"))
    return assign_ids(eras, id_col, ["person_id", concept, start], base)
