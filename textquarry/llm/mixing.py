"""Mixing sources to target weights.

Method: Sainte-Lague apportionment. The tokens to draw are cut into equal blocks; each shard of the
documents deals its blocks to the sources one by one, always to the highest quotient
target_share / (2 * blocks so far + 1), and never beyond what the source holds there times its allowed
repeats. Within a shard and source the documents are put in a seeded order, passes over the source one
after the other, and laid into blocks; those in the first blocks up to the quota are drawn. No document is
split: it belongs to the block that holds its middle.

Shards are drawn by a hash of the document, about `shard_documents` documents each, so a source that holds a third of
all rows is spread like the others; quotas are reckoned from one row per source and shard, and shares come
out right over all shards, because a shard has enough blocks for the rounding not to matter.

Where a source is out of reach, it gives all that its repeats allow and the rest of the blocks is dealt to
the others by the same quotients, so these keep their proportions.

Defined results: source names are compared without case, outer blanks and the choice of blank, hyphen or
underscore; documents of a null or untargeted source, and those without tokens, aren't drawn; null or
negative shares count as 0, null repeats as 1; a target without documents reaches 0; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import ship


def source_name(column: str) -> Column:
    """A source's name without differences of case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")


def sainte_lague(shares: np.ndarray, caps: np.ndarray, blocks: int) -> np.ndarray:
    """The blocks of each source: the highest quotients share / (2k + 1), k below the source's cap.
    Equal quotients go to the earlier source."""
    caps = np.where(shares > 0, np.minimum(caps, blocks), 0).astype(np.int64)
    if caps.sum() <= blocks:
        return caps
    owner = np.repeat(np.arange(len(caps)), caps)
    k = np.arange(caps.sum()) - np.repeat(np.cumsum(caps) - caps, caps)
    order = np.lexsort((owner, -shares[owner] / (2 * k + 1)))
    return np.bincount(owner[order[:blocks]], minlength=len(caps))


def _quotas(fraction: float, block_tokens: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        held = rows["held"].to_numpy(dtype=np.int64)
        caps = -(-held * rows["max_repeats"].to_numpy(dtype=np.int64) // block_tokens)  # an exhausted source also gives its last part of a block
        blocks = int(fraction * held.sum()) // block_tokens
        return rows.assign(quota=sainte_lague(rows["target_share"].to_numpy(), caps, blocks), blocks=blocks)[["shard", "source", "quota", "blocks"]]

    return run


def targets_of(targets: DataFrame) -> DataFrame:
    """The targets with clean names, shares and repeats; of equal names the largest share counts."""
    clean = targets.select(source_name("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("int").alias("max_repeats"))
    return clean.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))


def draw(sizes: DataFrame, targets: DataFrame, *, fraction: float = 1.0, block_tokens: int = 2048, shard_documents: int = 200_000, seed: int = 23) -> DataFrame:
    """The documents drawn: source, doc_id, n_tokens, n_uses. sizes: doc_id, source, n_tokens (unique ids).
    fraction: the tokens to draw as a multiple of those that the targeted sources hold."""
    aim = targets_of(targets)
    n_shards = max(1, -(-sizes.count() // shard_documents))
    docs = (
        sizes.where("n_tokens > 0").select(source_name("source").alias("source"), "doc_id", "n_tokens")
        .join(aim, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(n_shards)))
    )
    held = docs.groupBy("shard", "source").agg(F.sum("n_tokens").alias("held"), F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    ship(sizes.sparkSession)
    quotas = held.groupBy("shard").applyInPandas(_quotas(fraction, block_tokens), "shard long, source string, quota long, blocks long")
    w = Window.partitionBy("shard", "source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    placed = docs.withColumn("upto", F.sum("n_tokens").over(w)).join(held.select("shard", "source", "held"), ["shard", "source"]).join(quotas, ["shard", "source"])
    # in pass r the middle of a document lies r * held further; it is drawn in each pass where that is before the quota's end
    middle = F.col("upto") - F.col("n_tokens") / 2
    uses = F.greatest(F.lit(0), F.least(F.col("max_repeats"), F.ceil((F.col("quota") * block_tokens - middle) / F.col("held")))).cast("int")
    return placed.select("source", "doc_id", "n_tokens", uses.alias("n_uses")).where("n_uses > 0")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: documents and tokens held and drawn, the target share and the share reached, the
    most uses of a document, and whether the target lies within reach of its repeats."""
    aim = targets_of(targets)
    held = sizes.where("n_tokens > 0").groupBy(source_name("source").alias("source")).agg(F.count("*").alias("documents_held"), F.sum("n_tokens").alias("tokens_held"))
    got = drawn.groupBy("source").agg(F.count("*").alias("documents_drawn"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens_drawn"), F.max("n_uses").alias("most_uses"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    every = Window.partitionBy()  # one row per target
    joined = aim.join(held, "source", "left").join(got, "source", "left")
    return joined.select(
        "source", "target_share", "max_repeats", zero("documents_held").alias("documents_held"), zero("tokens_held").alias("tokens_held"), zero("documents_drawn").alias("documents_drawn"),
        zero("tokens_drawn").alias("tokens_drawn"), zero("most_uses").alias("most_uses"),
        F.try_divide(zero("tokens_drawn"), F.sum(zero("tokens_drawn")).over(every)).alias("share_reached"),
        (zero("tokens_held") * F.col("max_repeats") >= F.col("target_share") * F.sum(zero("tokens_held")).over(every)).alias("in_reach"),
    )
