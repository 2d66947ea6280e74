"""Schedules, losses and rates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_rate(step: Column, warmup: int, total: int, high: float, low: float) -> Column:
    """Linear warm-up, then a cosine from high to low."""
    share = (step - warmup) / F.lit(float(total - warmup))
    curve = F.lit(low) + F.lit(0.5 * (high - low)) * (1 + F.cos(F.pi() * share))
    return F.when(step < warmup, F.lit(high) * (step + 1) / F.lit(float(warmup))).when(step >= total, F.lit(low)).otherwise(curve)


def perplexity(loss: Column, most: float = 30.0) -> Column:
    return F.exp(F.least(loss, F.lit(most)))


def preference_loss(won: Column, lost: Column, beta: float = 0.1, variant: str = "dpo") -> Column:
    """The loss on the log-probability gains of a chosen and a rejected text."""
    soft = lambda z: F.log1p(F.exp(-z))
    if variant == "dpo":
        return soft(beta * (won - lost))
    if variant == "apo_zero":
        return soft(beta * won) + soft(-beta * lost)
    raise ValueError(variant)


def clipped_objective(new: Column, old: Column, reference: Column, advantage: Column, clip: float = 0.2) -> tuple[Column, Column]:
    """Policy term and divergence of a rollout from arrays of token log-probabilities, over the length
    they have in common; null where they have none."""
    n = F.least(F.size(new), F.size(old), F.size(reference))
    cut = lambda a: F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))

    def term(a: Column, b: Column) -> Column:
        ratio = F.exp(a - b)
        return F.least(ratio * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio)) * advantage)

    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    policy = F.when(n > 0, -total(F.zip_with(cut(new), cut(old), term)) / n)
    drift = F.when(n > 0, total(F.zip_with(cut(new), cut(reference), lambda a, b: a - b)) / n)
    return policy, drift


def is_night(ts: Column, night_start: str, day_start: str, zone: str = "UTC") -> Column:
    """Whether a UTC time lies in the night of a time zone; the night may wrap midnight."""
    minute = lambda s: int(s[:2]) * 60 + int(s[3:])
    local = F.from_utc_timestamp(ts, zone)
    now = F.hour(local) * 60 + F.minute(local)
    a, b = minute(night_start), minute(day_start)
    return (now >= a) & (now < b) if a < b else (now >= a) | (now < b)


def stamp(ts: Column, compact: bool = False) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss" if compact else "yyyy-MM-dd HH:mm:ss")
