"""Evaluation aggregates over long tables of scores (system, bench, dim, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.stats import stdev
from textquarry.functions.text import split_violations, strip
from textquarry.functions.training import perplexity


def summary(df: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """n, mean, deviation and the zero-filled histogram of the scores 0 to 4."""
    bins = [F.count(F.when(F.col(score) == k, 1)).alias(f"n_{k}") for k in range(5)]
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), stdev(score).alias("stdev"), *bins)


def two_levels(df: DataFrame, by: Sequence[str], finer: str, score: str = "score") -> DataFrame:
    """Means by a group and by the group with a finer column, which is null in the former's rows, in one
    pass."""
    sets = [[F.col(c) for c in by], [*[F.col(c) for c in by], F.col(finer)]]
    return df.groupingSets(sets, *[F.col(c) for c in [*by, finer]]).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.grouping(finer).cast("int").alias("is_total"))


def delta(df: DataFrame, by: Sequence[str], system: str, a: str, b: str, score: str = "score") -> DataFrame:
    """The means of two systems side by side, and b - a."""
    mean = lambda s: F.avg(F.when(F.col(system) == s, F.col(score)))
    return df.groupBy(*by).agg(mean(a).alias("mean_a"), mean(b).alias("mean_b")).withColumn("delta", F.col("mean_b") - F.col("mean_a"))


def all_deltas(means: DataFrame, by: Sequence[str], system: str, value: str) -> DataFrame:
    """The difference of each pair of systems, the earlier name first; means has one row per system."""
    a = means.select(*by, F.col(system).alias("a"), F.col(value).alias("_a"))
    b = means.select(*by, F.col(system).alias("b"), F.col(value).alias("_b"))
    return a.join(b, list(by)).where("a < b").select(*by, "a", "b", (F.col("_a") - F.col("_b")).alias("delta"))


def verdict(mean_delta: Column, margin: float = 0.05) -> Column:
    return F.when(mean_delta > margin, "ahead").when(mean_delta > -margin, "parity").otherwise("behind")


def against_threshold(value: Column, least: float) -> Column:
    return F.when(value >= least, "pass").otherwise("fail")


def without_sentinel(score: str, dim: str, only: str, sentinel: float = -1) -> Column:
    """A mean that leaves out the sentinel, in one dimension alone; an aggregate."""
    return F.avg(F.when(~((F.col(dim) == only) & (F.col(score) == sentinel)), F.col(score)))


def described(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, deviation, least and most."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), stdev(value).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("most"))


def length_profile(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, least, most, the exclusive deciles 1 and 9 and the value at nine tenths of the
    sorted lengths. Below ten values the deciles are the least and the most. Values at a rank are found
    from the running count of the distinct lengths, so nothing holds the rows of a group; a group has as
    many distinct lengths as its longest text has words at most."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumns({"_upto": F.sum("_k").over(w), "_n": F.sum("_k").over(Window.partitionBy(*by)), "_v": F.col(value).cast("double")})
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))

    def decile(k: int) -> Column:
        j = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.lit(k) * (F.col("_n") + 1) / 10)))
        over = F.first(F.lit(k) * (F.col("_n") + 1) - j * 10)
        return F.when(F.first("_n") < 10, F.min("_v") if k < 5 else F.max("_v")).otherwise((at(j) * (10 - over) + at(j + 1) * over) / 10.0)

    middle = (at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2
    out = upto.groupBy(*by).agg(
        F.first("_n").alias("n"), (F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("mean"), middle.alias("median"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        decile(1).alias("p10"), decile(9).alias("p90"), at(F.least(F.floor(F.col("_n") * 0.9) + 1, F.col("_n"))).alias("at_90"),
    )
    return out


def pairwise(df: DataFrame) -> DataFrame:
    """Wins by condition, slots undone. df: id, winner (A, B or TIE in any case), slot_a, slot_b. An empty
    or absent winner is a tie; any other counts under a null winner."""
    w = F.upper(F.coalesce("winner", F.lit("")))
    won = F.when(w == "A", F.col("slot_a")).when(w == "B", F.col("slot_b")).when(w.isin("TIE", ""), F.lit("tie"))
    return df.withColumn("won", won).groupBy("won").agg(F.count("*").alias("n"))


def pairwise_dims(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Wins of each condition in each dimension, by the higher score; equal scores tie, a missing one
    leaves the dimension out. df: slot_a, slot_b and the structs scores_a, scores_b of the dimensions."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"scores_a.{d}").alias("a"), F.col(f"scores_b.{d}").alias("b")) for d in dims)))
    long = df.select("slot_a", "slot_b", each.alias("x")).where("x.a is not null and x.b is not null")
    won = F.when(F.col("x.a") > F.col("x.b"), F.col("slot_a")).when(F.col("x.a") < F.col("x.b"), F.col("slot_b")).otherwise("tie")
    return long.groupBy(F.col("x.dim").alias("dim"), won.alias("won")).agg(F.count("*").alias("n"))


def preference_pairs(df: DataFrame, references: DataFrame, prompt: str, text: str, order: str, *, reward: str = "reward", reason: str = "reason", margin: float = 0.2, most: int = 2) -> DataFrame:
    """Chosen and rejected texts of each prompt: its reference beside the worst rollout, and the best
    rollout beside the worst where the best is sound (reason ok) and at least `margin` better; texts that
    are equal but for white space at the ends make no pair. references: prompt key, reference."""
    ends = best_and_worst(df, prompt, reward, order, text, reward, reason)
    joined = ends.join(references.select(prompt, "reference"), prompt, "left")
    best, worst, ref = F.col(f"best.{text}"), F.col(f"worst.{text}"), F.col("reference")
    high, low = F.col(f"best.{reward}"), F.col(f"worst.{reward}")
    pair = lambda chosen, src, score: F.struct(chosen.alias("chosen"), worst.alias("rejected"), F.lit(src).alias("chosen_src"), F.lit("onpolicy_worst").alias("rejected_src"), F.round(score, 4).alias("chosen_score"), F.round(low, 4).alias("rejected_score"))
    first = F.when(ref.isNotNull() & (worst != "") & (strip(ref) != strip(worst)), pair(ref, "p4", F.lit(1.0)))
    second = F.when((F.col(f"best.{reason}") == "ok") & (high - low >= margin) & (strip(best) != strip(worst)), pair(best, "onpolicy_best", high))
    kept = F.slice(F.filter(F.array(first, second), lambda p: p.isNotNull()), 1, most)
    return joined.select(prompt, F.explode(kept).alias("p")).select(prompt, "p.*")


def jury(df: DataFrame, item: str, dim: str, least: int = 2) -> DataFrame:
    """The jurors' mean per item and dimension; null under `least` valid scores."""
    return df.groupBy(item, dim).agg(F.count("score").alias("n_valid"), F.avg("score").alias("_m")).withColumn("jury_mean", F.when(F.col("n_valid") >= least, F.col("_m"))).drop("_m")


def joined_truth(scores: DataFrame, truth: DataFrame, key: str = "opaque_id") -> tuple[DataFrame, DataFrame]:
    """Scores with what their ids stand for, and the number of scores of unknown ids."""
    known = scores.join(truth, key)
    return known, scores.join(truth.select(key), key, "left_anti").agg(F.count("*").alias("n_unknown"))


def group_advantage(df: DataFrame, group: str, reward: str, floor: float = 1e-6) -> DataFrame:
    """(reward - group mean) / (deviation + floor), deviation 0 in groups of one. The means come from an
    aggregate joined back, so a group that holds much of the table is never gathered in one task."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_m"), stdev(reward).alias("_s"))
    return df.join(stats, group).withColumn("group_advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + floor)).drop("_m", "_s")


def best_and_worst(df: DataFrame, group: str, score: str, order: str, *keep: str) -> DataFrame:
    """The last best and the first worst row of each group in the order, as the ends of a stable sort by
    the score."""
    cols = F.struct(*keep)
    rank = F.struct(F.col(score), F.col(order))
    return df.groupBy(group).agg(F.max_by(cols, rank).alias("best"), F.min_by(cols, rank).alias("worst"), F.count("*").alias("n"))


def compliance_rates(df: DataFrame, violations: str, allowed: Sequence[str], *by: str) -> DataFrame:
    """The share of rows without violations, the share without any but allowed proper nouns, and the mean
    number of lexical violations; rows without a list are left out."""
    parts = split_violations(violations, allowed)
    adjusted = (F.size(parts["lexical"]) == 0) & (F.size(parts["proper_other"]) == 0)
    share = lambda c: F.avg(c.cast("double"))
    return df.where(F.col(violations).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), share(F.size(violations) == 0).alias("strict_rate"), share(adjusted).alias("adjusted_rate"), F.avg(F.size(parts["lexical"])).alias("mean_lexical"))


def overall_loss(losses: DataFrame) -> DataFrame:
    """The loss over all sources, each weighted by its batches, and its perplexity. losses: loss, n_batches."""
    loss = F.sum(F.col("loss") * F.col("n_batches")) / F.sum("n_batches")
    return losses.where("n_batches > 0").agg(loss.alias("overall_loss"), perplexity(loss).alias("overall_ppl"))


def halted(df: DataFrame, order: str, value: str, rows: int = 50, most: float = 0.15, *by: str) -> DataFrame:
    """Whether the mean of the last `rows` rows exceeds a bound, where that many rows exist."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({"trailing": F.avg(value).over(w), "_n": F.count(F.lit(1)).over(w)}).withColumn("halt", (F.col("_n") == rows) & (F.col("trailing") > most)).drop("_n")
