"""Keys, hashes and deterministic order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import strip


def doc_key(id_col: str | Column) -> Column:
    """The document of a passage id: all before the last hyphen, the whole id without one."""
    return F.regexp_replace(id_col, r"-[^-]*$", "")


def content_hash(text: str | Column, length: int = 12) -> Column:
    """The first characters of the MD5 of a stripped text."""
    return F.substring(F.md5(strip(text)), 1, length)


def bucket(id_col: str | Column, buckets: int = 10_000) -> Column:
    """A bucket from the first 32 bits of the id's MD5, the same on every engine."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def in_holdout(id_col: str | Column, fraction: float, buckets: int = 10_000) -> Column:
    """Whether a stable hash puts the id into the held-out fraction; never for an empty or null id or a
    fraction of 0 or less. The bound is cut to whole buckets."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    if fraction <= 0:
        return F.lit(False)
    return F.coalesce((col != "") & (bucket(col, buckets) < int(fraction * buckets)), F.lit(False))


def seeded(seed: int | str, *cols: str | Column) -> Column:
    """A key to order by: every seed gives another shuffle, and the same one on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def unit(seed: int | str, *cols: str | Column) -> Column:
    """A number in [0, 1) from the same hash, in steps of 2 ** -32."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
