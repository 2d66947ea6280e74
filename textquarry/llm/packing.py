"""Filling fixed-capacity containers with items.

Method: first-fit decreasing with a tournament tree over the free room of the bins, so the first bin with
room is found in a logarithmic number of steps; run independently in groups of items that a seeded hash
draws at random, each of about `group_items` items, so no task holds more and every group sees the same
mixture of sizes. An item is split only where it alone exceeds the capacity: into full containers and a
rest that is packed like an item.

Defined results: items of no tokens (null or blank texts) take no room and aren't laid out; equal sizes are
laid in the order of their id; a repeated id is laid out once for each row; a null or non-positive capacity
gives no bins; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import ship

LAYOUT = "pack_name string, capacity long, bin_id long, position int, doc_id long, piece int, start_token long, n_tokens long"


class Bins:
    """Bins in the order of their opening; the root of the tree holds the largest free room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put an item into the first bin with room for it."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        at = k - self.leaves
        while k > 1:
            k //= 2
            a, b = tree[2 * k], tree[2 * k + 1]
            top = a if a > b else b
            if tree[k] == top:
                break
            tree[k] = top
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes in decreasing order, none above the capacity."""
    bins = Bins(max(len(sizes), 1), capacity)
    return np.fromiter((bins.place(s) for s in sizes.tolist()), dtype=np.int64, count=len(sizes))


def _pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    name, capacity, group = key
    items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    where = first_fit_decreasing(items["n_tokens"].to_numpy(), int(capacity))
    out = items.assign(bin=where).sort_values("bin", kind="stable")
    out["position"] = out.groupby("bin").cumcount().astype("int32")
    out["bin_id"] = (int(group) << 32) + out["bin"]
    return out.assign(pack_name=name, capacity=int(capacity))[["pack_name", "capacity", "bin_id", "position", "doc_id", "piece", "start_token", "n_tokens"]]


def layout(sizes: DataFrame, packs: DataFrame, *, group_items: int = 20_000, seed: int = 11) -> DataFrame:
    """One row for each piece of an item in its place. sizes: doc_id, n_tokens; packs: pack_name,
    capacity_tokens (a small table of settings). bin_id is unique within a pack."""
    pieces = None
    total = sizes.where("n_tokens > 0").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    for p in packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct().toLocalIterator():
        starts = F.expr(f"sequence(0L, n_tokens - 1, {p.capacity}L)")
        n_groups = max(1, -(-(total.n + (total.t or 0) // p.capacity) // group_items))
        part = (
            sizes.where("n_tokens > 0")
            .select("doc_id", "n_tokens", F.posexplode(starts).alias("piece", "start_token"))
            .select(
                F.lit(p.pack_name).cast("string").alias("pack_name"), F.lit(p.capacity).cast("long").alias("capacity"),
                F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), F.lit(n_groups)).alias("group"),
                "doc_id", "piece", "start_token", F.least(F.lit(p.capacity), F.col("n_tokens") - F.col("start_token")).alias("n_tokens"),
            )
        )
        pieces = part if pieces is None else pieces.unionAll(part)
    if pieces is None:
        return sizes.sparkSession.createDataFrame([], LAYOUT)
    ship(sizes.sparkSession)
    return pieces.groupBy("pack_name", "capacity", "group").applyInPandas(_pack, LAYOUT)


def report(laid: DataFrame) -> DataFrame:
    """For each pack: bins, items, items split, tokens, the fewest bins that could hold them, and the
    share of the room that is used."""
    per_item = laid.groupBy("pack_name", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    items = per_item.groupBy("pack_name", "capacity").agg(F.count("*").alias("n_items"), F.count(F.when(F.col("pieces") > 1, 1)).alias("n_split"), F.sum("tokens").alias("n_tokens"))
    bins = laid.groupBy("pack_name", "capacity", "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy("pack_name", "capacity").agg(F.count("*").alias("n_bins"), F.max("used").alias("fullest"))
    return items.join(bins, ["pack_name", "capacity"]).select("pack_name", "capacity", "n_items", "n_split", "n_tokens", "n_bins", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), "fullest", (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("fill_rate"))
