"""Source codes to standard concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from medweave.functions.vocabulary import MAPPABLE, normalise_code, normalise_vocab, route_domain
from medweave.operators.keyed import latest_per_key
from medweave.operators.skew import skew_anti_join, skew_join

MAP_COLUMNS = ("vocab", "code", "source_id", "target_id", "destination", "target_order")


def delete_invalid_relationships(df: DataFrame) -> DataFrame:
    return df.where(F.col("invalid_reason").isNull() | (F.col("invalid_reason") == ""))


def valid_maps_to(df: DataFrame) -> DataFrame:
    """Usable ``Maps to`` rows: both ids there, not marked invalid."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("concept_id_1", "concept_id_2")]
    valid = F.coalesce(F.col("invalid_reason"), F.lit("")) == ""
    return df.where((F.col("relationship_id") == "Maps to") & valid & filled[0] & filled[1])


def mappable_vocab(df: DataFrame, vocabs: tuple[str, ...] = MAPPABLE) -> DataFrame:
    return df.where(F.col("vocab").isin(*vocabs))


def _links(concept: DataFrame, maps_to: DataFrame) -> DataFrame:
    """Each usable relationship with the destination of its target; NULL where the target does not exist or route."""
    targets = concept.select(
        F.col("concept_id").alias("target_id"), route_domain(F.col("domain_id")).alias("destination")
    ).where(F.col("destination").isNotNull())
    links = maps_to.select(
        F.col("concept_id_1").alias("source_id"), F.col("concept_id_2").alias("target_id"), F.col("ordinal").alias("target_order")
    )
    return skew_join(links, targets, ["target_id"], "left")


def resolve_targets(concept: DataFrame, maps_to: DataFrame) -> DataFrame:
    """Target concept and destination of each usable relationship whose target exists and routes."""
    return _links(concept, maps_to).where(F.col("destination").isNotNull())


def concept_map(concept: DataFrame, relationship: DataFrame) -> DataFrame:
    """One row per (vocab, code) and target; both inputs carry their row order in ``ordinal``.

    A code that maps only to targets that do not exist or do not route has one row without a
    target: it is known, but writes nothing. A concept without a relationship stands for itself
    with target 0. Of several concepts with the same code the last one counts, unless it has
    neither a relationship nor a destination.

    Concepts and relationships, told apart by which struct they fill, meet in one grouping by source id, where a concept's
    targets become an array; that array is carried to the code's last concept and unfolded at the end.
    """
    kind = concept.schema["concept_id"].dataType
    sources = mappable_vocab(
        concept.where(F.col("concept_id").isNotNull()).select(
            F.col("concept_id").alias("source_id"), normalise_vocab(F.col("vocabulary_id")).alias("vocab"),
            normalise_code(F.col("concept_code")).alias("code"), route_domain(F.col("domain_id")).alias("own"), "ordinal",
        )
    ).select("source_id", F.struct("vocab", "code", "own", "ordinal").alias("concept"))
    links = _links(concept, valid_maps_to(relationship)).select(
        F.col("source_id").cast(kind).alias("source_id"), F.struct(F.col("target_id").cast(kind).alias("target_id"), "destination", "target_order").alias("link")
    )
    met = sources.unionByName(links, allowMissingColumns=True).groupBy("source_id").agg(
        F.collect_list("concept").alias("concepts"),  # one, unless an id is given to several concepts
        F.max(F.col("link").isNotNull()).alias("linked"),
        F.collect_list(F.when(F.col("link.destination").isNotNull(), F.col("link"))).alias("targets"),  # what one concept maps to
    )
    candidates = met.select("source_id", "linked", "targets", F.explode("concepts").alias("c")).select("source_id", "linked", "targets", "c.*")
    winners = latest_per_key(candidates.where(F.col("linked") | F.col("own").isNotNull()), ["vocab", "code"], ["ordinal"])
    nothing = F.lit(None)
    itself = F.struct(F.lit(0).cast(kind).alias("target_id"), F.col("own").alias("destination"), nothing.cast(relationship.schema["ordinal"].dataType).alias("target_order"))
    written = F.when(~F.col("linked"), F.array(itself)).otherwise(F.col("targets"))
    return winners.select("vocab", "code", "source_id", F.explode_outer(written).alias("t")).select("vocab", "code", "source_id", "t.*").select(*MAP_COLUMNS)


def lookup_codes(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the mapping to each code; ``known`` is false where the map has no such code."""
    marked = mapping.withColumn("known", F.lit(True))
    found = skew_join(codes, marked, ["vocab", "code"], "left")
    return found.withColumn("known", F.coalesce("known", F.lit(False)))


def fact_targets(found: DataFrame, destination: str | None = None) -> DataFrame:
    """Rows of :func:`lookup_codes` that write a fact, for one destination or for all of them."""
    writes = found.where(F.col("target_id").isNotNull())
    return writes if destination is None else writes.where(F.col("destination") == destination)


def unmapped_codes(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of ``codes`` the map does not know."""
    return skew_anti_join(codes, mapping, ["vocab", "code"])


def unmapped_frequency(codes: DataFrame, mapping: DataFrame, min_count: int = 1) -> DataFrame:
    """How often each unknown code occurs, most frequent first; counted before the map is looked up."""
    counted = codes.groupBy("vocab", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return counted.join(mapping.select("vocab", "code").distinct(), ["vocab", "code"], "left_anti").orderBy(
        F.desc("n"), "vocab", "code"
    )


def source_code_summary(codes: DataFrame) -> DataFrame:
    return codes.groupBy("feed", "vocab", "code").agg(F.count(F.lit(1)).alias("n"))
