"""Distances and links between profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.components import components
from typeweave.operators.encode import numbered


def distance_to_anchor(profiles: DataFrame, anchor: DataFrame, key: str, profile: str, most: int) -> DataFrame:
    """(key, distance, compared, member): loci called in both that differ, from the one anchor profile.

    ``anchor`` has one row with a column ``profile``; it is checked to be one and
    broadcast. Profiles are arrays with null for a missing call.
    """
    one = anchor.select(F.col(profile).alias("_anchor")).agg(
        F.when(F.count(F.lit(1)) == 1, F.first("_anchor")).otherwise(F.raise_error(F.lit("the anchor isn't one profile"))).alias("_anchor")
    )
    pairs = F.arrays_zip(F.col(profile).alias("x"), F.col("_anchor").alias("y"))
    called = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    differ = F.size(F.filter(called, lambda p: p["x"] != p["y"])).cast("bigint")
    return profiles.crossJoin(F.broadcast(one)).select(key, differ.alias("distance"), F.size(called).cast("bigint").alias("compared"), (differ <= most).alias("member"))


def masks(profiles: DataFrame, key: str, loci: list[str]) -> DataFrame:
    """(key, locus, mask): for each locus, the values of all others, where none is null.

    Two profiles differ in at most one locus, a missing value counting as a
    difference, exactly if they share a mask; so links come from an equi-join
    instead of a comparison of all pairs.
    """
    each = []
    for k, _ in enumerate(loci):
        others = [F.col(l).cast("string") for i, l in enumerate(loci) if i != k]
        known = ~F.exists(F.array(*others), lambda x: x.isNull())
        each.append(F.struct(F.lit(k).alias("locus"), F.when(known, F.array(*others)).alias("mask")))
    return profiles.select(key, F.explode(F.array(*each)).alias("m")).select(key, "m.*").where("mask IS NOT NULL")


def link_counts(profiles: DataFrame, key: str, loci: list[str]) -> DataFrame:
    """(key, links): other distinct profiles that differ in exactly one locus. Groups are counted, never expanded."""
    shared = masks(profiles, key, loci)
    sizes = shared.groupBy("locus", "mask").agg(F.count(F.lit(1)).alias("size"))
    counted = shared.join(sizes, ["locus", "mask"]).groupBy(key).agg(F.sum(F.col("size") - 1).alias("links"))
    return profiles.select(key).join(counted, key, "left").select(key, F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def complexes(profiles: DataFrame, key: str, loci: list[str]) -> DataFrame:
    """(key, complex): linked profiles together, complexes numbered from 1 by their first profile.

    Every group that shares a mask is linked through its least key, so edges are
    at most as many as masks.
    """
    shared = masks(profiles, key, loci)
    least = shared.groupBy("locus", "mask").agg(F.min(key).alias("least"), F.max(key).alias("last")).where("least < last")
    edges = shared.join(least.drop("last"), ["locus", "mask"]).where(F.col(key) != F.col("least")).select(F.col("least").alias("a"), F.col(key).alias("b")).distinct()
    joined = profiles.select(key).join(components(edges).withColumnRenamed("node", key), key, "left")
    named = joined.select(key, F.coalesce("component", key).alias("component"))
    numbers = numbered(named.select("component").distinct(), "component", "complex")
    return named.join(numbers, "component").select(key, F.col("complex").cast("bigint").alias("complex"))
