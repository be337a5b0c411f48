"""Routing rows to groups of references by similarity and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import shingles
from .filters import contained_references
from .lineage import few, spread
from .similarity import BROADCAST_ROWS, SMALL_SET, shared_counts, shared_shingles


def route_scores(df: DataFrame, key: str, text: str, references: DataFrame) -> DataFrame:
    """Rows (key, grp, sim, contained, combined) for groups with anything in common; references: ref_id, site, pattern.

    sim is the highest similarity to a reference of the group; a contained
    reference adds 1.  Groups that are absent score 0.
    """
    df = spread(df.select(key, text))
    refs = references.select(F.col("ref_id").alias("r"), F.col("pattern").alias("text"))
    groups = references.select("ref_id", F.explode(F.split("site", r"\|")).alias("grp"))
    sims = shared_shingles(df.select(F.col(key).alias("l"), F.col(text).alias("text")), refs).select(F.col("l").alias(key), F.col("r").alias("ref_id"), "sim", F.lit(False).alias("contained"))
    held = contained_references(df, key, text, references).select(key, "ref_id", F.lit(0.0).alias("sim"), F.lit(True).alias("contained"))
    groups = F.broadcast(groups) if few(groups, BROADCAST_ROWS) else groups
    scored = sims.unionByName(held).join(groups, "ref_id").groupBy(key, "grp").agg(F.max("sim").alias("sim"), F.bool_or("contained").alias("contained"))
    return scored.withColumn("combined", F.col("sim") + F.col("contained").cast("int"))


def assign(scores: DataFrame, key: str, sizes: DataFrame | None = None, threshold: float = 0.0, allowed: list[str] | None = None, strict: bool = False) -> DataFrame:
    """One row per key: its group, or null where the best is not enough.

    The group of the highest combined score wins; among equals the larger group
    (``sizes``: grp, size; without it none is larger), then the first label.  A
    contained reference always assigns, unless ``strict`` asks for the threshold
    as well; without one the similarity must reach the threshold and be above 0.
    """
    rows = scores if allowed is None else scores.where(F.col("grp").isin(allowed))
    if sizes is not None and few(sizes, BROADCAST_ROWS):
        sizes = F.broadcast(sizes)
    rows = rows.join(sizes, "grp", "left") if sizes is not None else rows.withColumn("size", F.lit(0))
    order = Window.partitionBy(key).orderBy(F.desc("combined"), F.desc("size"), "grp")
    best = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    enough = (F.col("sim") >= threshold) & (F.col("combined") > 0)
    if not strict:
        enough = enough | F.col("contained")
    return best.select(key, F.when(enough, F.col("grp")).alias("assigned"), "sim", "contained", "combined")


def assign_many(scores: DataFrame, key: str, margin: float) -> DataFrame:
    """All groups with a contained reference and those within ``margin`` of the key's best combined score."""
    best = F.max("combined").over(Window.partitionBy(key))
    return scores.withColumn("_best", best).where(F.col("contained") | (F.col("combined") >= F.col("_best") - margin)).select(key, "grp", "combined")


def group_features(df: DataFrame, key: str, scores: DataFrame, groups: list[str]) -> DataFrame:
    """One row per key with sim and containment (0 or 1) columns of every group; 0 where there is none."""
    wide = scores.groupBy(key).pivot("grp", groups).agg(F.max("sim").alias("sim"), F.max(F.col("contained").cast("double")).alias("contained"))
    return df.select(key).join(wide, key, "left").na.fill(0.0)


def signature_match(df: DataFrame, key: str, item: str, signatures: DataFrame) -> DataFrame:
    """Per key and group: share of the group's signature items present, and which; signatures: grp, item."""
    sizes = signatures.groupBy("grp").agg(F.count_distinct(F.col("item")).alias("size"))
    wanted = F.broadcast(signatures.distinct()) if few(signatures, BROADCAST_ROWS) else signatures.distinct()
    hits = df.select(key, F.col(item).alias("item")).distinct().join(wanted, "item")
    found = hits.groupBy(key, "grp").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("matched"))
    return found.join(sizes, "grp").select(key, "grp", (F.col("n") / F.col("size")).alias("share"), "matched")


def group_similarity(references: DataFrame) -> DataFrame:
    """Mean and maximum similarity of references across each pair of groups, identical texts left out."""
    sets = references.select("ref_id", "pattern", F.explode(F.split("site", r"\|")).alias("grp"), shingles(F.col("pattern"), "word", 1).alias("items"))
    pairs = shared_counts(sets.select(F.col("ref_id").alias("l"), "items").distinct(), sets.select(F.col("ref_id").alias("r"), "items").distinct())
    a, b = sets.select(F.col("ref_id").alias("l"), F.col("grp").alias("g1"), F.col("pattern").alias("p1")), sets.select(F.col("ref_id").alias("r"), F.col("grp").alias("g2"), F.col("pattern").alias("p2"))
    if not few(references, SMALL_SET):
        raise ValueError(f"all pairs of more than {SMALL_SET} references")
    # All pairs of the (small, stated) reference set, so that pairs with nothing in common count as 0.
    every = a.join(F.broadcast(b), F.col("p1") != F.col("p2")).join(pairs, ["l", "r"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return every.groupBy("g1", "g2").agg(F.avg("sim").alias("mean"), F.max("sim").alias("max"), F.count(F.lit(1)).alias("n"))
