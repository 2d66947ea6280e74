"""Deterministic samples, splits and assignments by hashed order: the same on every run and engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.keys import doc_key, seeded, unit
from textquarry.operators.numbering import numbered


def uniform(df: DataFrame, k: int, seed: int, *key: str) -> DataFrame:
    """k rows at random; plans as a top-k, so no task sorts the table."""
    return df.orderBy(seeded(seed, *key), *key).limit(k)


def ranked_within(df: DataFrame, stratum: Sequence[str], seed: int, *key: str, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*stratum).orderBy(seeded(seed, *key), *key)
    return df.withColumn(name, F.row_number().over(w))


def top_within(df: DataFrame, stratum: Sequence[str], bound: str, seed: int, *key: str, parts: int = 64) -> DataFrame:
    """The first `bound` rows (a column, equal within a stratum) of each stratum in hashed order.

    Taken twice: within `parts` parts of a stratum and then of what these leave, so a stratum that holds
    much of the table isn't sorted in one task; the first rows of a whole are among the first of its parts."""
    parted = df.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    few = ranked_within(parted, [*stratum, "_part"], seed, *key, name="_rank").where(F.col("_rank") <= F.col(bound)).drop("_rank", "_part")
    return ranked_within(few, stratum, seed, *key, name="_rank").where(F.col("_rank") <= F.col(bound)).drop("_rank")


def stratified(df: DataFrame, n: int, stratum: str, seed: int, *key: str) -> DataFrame:
    """About n rows, each stratum by its share (one row at least), cut to n by another shuffle."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = df.count()
    share = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.lit(float(max(total, 1))), 0).cast("int"))
    sized = sizes.select(F.col(stratum).alias("_s"), share.alias("_share"))
    bounded = df.join(sized, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    kept = top_within(bounded, [stratum], "_share", seed, *key).drop("_share")
    return kept.orderBy(seeded(seed + 1, *key), *key).limit(n)


def holdout_documents(df: DataFrame, fraction: float, source: str, id_col: str, seed: int) -> DataFrame:
    """The documents held out of each source, at least one: (source, doc)."""
    docs = df.select(F.col(source).alias("source"), doc_key(id_col).alias("doc")).distinct()
    sizes = docs.groupBy("source").agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction), 0).cast("int")).alias("_n"))
    return top_within(docs.join(sizes, "source"), ["source"], "_n", seed, "source", "doc").select("source", "doc")


def weighted_choice(seed: int, weights: Sequence[tuple[str, float]], *key: str) -> Column:
    """One of the names by weight, from the hash of the key."""
    total, upto, u = float(sum(w for _, w in weights)), 0.0, unit(seed, *key)
    out = None
    for name, w in weights[:-1]:
        upto += w / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def with_replacement(pool: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n draws from a pool, with repeats: draw, and the pool's columns."""
    order = numbered(pool, *key, name="_at")
    size = pool.count()
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), (F.floor(unit(seed, F.col("id")) * size) + 1).alias("_at"))
    return draws.join(order, "_at").drop("_at")


def coin(seed: int, *key: str) -> Column:
    """True or false by one bit of the hash."""
    return F.substring(seeded(seed, *key), 1, 1).isin(*"01234567")


def round_robin(df: DataFrame, choices: Sequence[str], *order: str, name: str = "assigned") -> DataFrame:
    """The choices in turn, over the rows in order."""
    arr = F.array(*[F.lit(c) for c in choices])
    out = numbered(df, *order)
    return out.withColumn(name, F.get(arr, F.pmod(F.col("rn") - 1, F.lit(len(choices))).cast("int")))


def one_per_tier(df: DataFrame, tier: Sequence[str], seed: int, *key: str) -> DataFrame:
    """A random row of each tier, and how many the tier has; an aggregate, so no tier is gathered."""
    rest = [c for c in df.columns if c not in tier]
    best = F.min_by(F.struct(*rest), F.struct(seeded(seed, *key), *key))
    return df.groupBy(*tier).agg(best.alias("_r"), F.count("*").alias("tier_size")).select(*tier, *[F.col(f"_r.{c}").alias(c) for c in rest], "tier_size")
