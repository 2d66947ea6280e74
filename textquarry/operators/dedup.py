"""Duplicates, set operations and lookups by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.keys import content_hash


def first_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key in the given order. An aggregate, so repeats meet before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key, as a later entry of a dictionary replaces an earlier one."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def exact(df: DataFrame, text: str, order: str, scope: Sequence[str] = ()) -> DataFrame:
    """The first of equal trimmed texts within a scope, by content hash."""
    return first_by(df.where(F.col(text).isNotNull()).withColumn("_h", content_hash(F.col(text))), [*scope, "_h"], order).drop("_h")


def pending(assigned: DataFrame, done: DataFrame, key: str, retry_failures: bool = False, failed: Column | None = None) -> DataFrame:
    """What is assigned and not done; with retry_failures a failed record doesn't count as done."""
    finished = done.where(~F.coalesce(failed, F.lit(False))) if retry_failures and failed is not None else done
    return assigned.join(finished.select(key).distinct(), key, "left_anti")


def excluded(df: DataFrame, held: DataFrame, key: Column, bucketed: Column | None = None, only: bool = False) -> DataFrame:
    """Rows outside a held-out set of keys (and a hash bucket), or only those inside it."""
    flag = df.withColumn("_k", key).join(held.select(F.col(held.columns[0]).alias("_k"), F.lit(True).alias("_held")).distinct(), "_k", "left")
    inside = F.coalesce("_held", F.lit(False)) | (bucketed if bucketed is not None else F.lit(False))
    return flag.where(inside if only else ~inside).drop("_k", "_held")


def patched(df: DataFrame, lookup: DataFrame, key: str, target: str, value: str) -> DataFrame:
    """The target replaced where the lookup holds a non-empty value, kept otherwise; and whether it was."""
    found = df.join(lookup.select(key, F.col(value).alias("_v")), key, "left")
    hit = F.coalesce(F.col("_v") != "", F.lit(False))
    return found.withColumns({target: F.when(hit, F.col("_v")).otherwise(F.col(target)), "was_patched": hit}).drop("_v")


def stripped(records: DataFrame, progress: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records without those not compliant (a missing flag counts as compliant), and the progress
    without their keys, so that they are made again."""
    bad = records.where(~F.coalesce("compliant", F.lit(True))).select(key).distinct()
    return records.where(F.coalesce("compliant", F.lit(True))), progress.join(bad, key, "left_anti")


def merged_manifest(manifest: DataFrame, fresh: DataFrame, label: str) -> DataFrame:
    """The manifest with a label's rows replaced."""
    return manifest.where(F.col("label") != label).unionByName(fresh)
