"""Row numbers over a whole table without a single task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import materialise


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """A column with 1, 2, 3, ... in the given order (ties need a last unique column).

    Rows are put into ranges of the order and numbered within each; the ranges' sizes, one number each,
    give the offsets. The ranges are written once, since a range drawn anew might differ."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row per range
    offsets, total = [], 0
    for k in sorted(sizes):
        offsets += [F.lit(k), F.lit(total)]
        total += sizes[k]
    offset = F.create_map(*offsets)[F.col("_range")] if offsets else F.lit(0)
    w = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn(name, (F.row_number().over(w) + offset).cast("long")).drop("_range")


def batches(df: DataFrame, *order: str, size: int) -> DataFrame:
    """Batch and place in it, both from 1, of `size` rows each in the given order."""
    out = numbered(df, *order)
    return out.withColumn("batch", F.floor((F.col("rn") - 1) / size) + 1).withColumn("place", F.pmod(F.col("rn") - 1, F.lit(size)) + 1)


def near_equal(df: DataFrame, *order: str, parts: int) -> DataFrame:
    """A part from 1 to `parts` for each row; sizes differ by one at most, the larger ones first."""
    out = numbered(df, *order)
    n = df.count()
    big, rest = divmod(n, parts)
    i = F.col("rn") - 1
    edge = rest * (big + 1)
    part = F.when(i < edge, F.floor(i / (big + 1))).otherwise(rest + F.floor((i - edge) / max(big, 1)))
    return out.withColumn("part", (part + 1).cast("long"))


def opaque(df: DataFrame, prefix: str, width: int = 6) -> DataFrame:
    """An id that tells nothing, from the row number, which is padded to `width` and never shortened."""
    return df.withColumn("opaque_id", F.concat(F.lit(prefix + "-"), F.when(F.col("rn").isNotNull(), F.format_string(f"%0{width}d", F.col("rn").cast("long")))))
