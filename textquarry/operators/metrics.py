"""Overlap metrics of text pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.stats import lcs_length, overlap_f1
from textquarry.functions.text import split_words


def unigram_bleu(df: DataFrame, id_col: str, original: str, made: str) -> DataFrame:
    """Clipped precision of the words times the length ratio up to 1. Inside the row: each distinct word
    is counted in both arrays, so nothing is shuffled."""
    o, m = split_words(F.lower(F.coalesce(F.col(original), F.lit("")))), split_words(F.lower(F.coalesce(F.col(made), F.lit(""))))
    rows = df.select(id_col, o.alias("_o"), m.alias("_m"))
    times = lambda arr, w: F.size(arr) - F.size(F.array_remove(arr, w))
    common = F.aggregate(F.transform(F.array_distinct("_m"), lambda w: F.least(times(F.col("_m"), w), times(F.col("_o"), w))), F.lit(0), lambda s, v: s + v)
    score = F.when(F.size("_m") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size("_m") / F.greatest(F.size("_o"), F.lit(1))) * common / F.size("_m"))
    return rows.select(id_col, score.alias("bleu"))


def rouge_l(df: DataFrame, id_col: str, original: str, made: str) -> DataFrame:
    """The F1 of the longest common subsequence of words, as a fold in the row; for short texts."""
    o, m = split_words(F.lower(F.coalesce(F.col(original), F.lit("")))), split_words(F.lower(F.coalesce(F.col(made), F.lit(""))))
    rows = df.select(id_col, o.alias("_o"), m.alias("_m"))
    return rows.select(id_col, overlap_f1(lcs_length("_o", "_m").cast("double"), F.size("_o"), F.size("_m")).alias("rouge_l"))


def _lcs(a: list[str], b: list[str]) -> int:
    """By bits: one big number holds a row of the table, so a row takes a few operations."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    every, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(b) - row.bit_count()


def rouge_l_long(df: DataFrame, id_col: str, original: str, made: str) -> DataFrame:
    """The same for texts of any length, in Arrow batches."""

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a.fillna("").str.lower().str.split(), b.fillna("").str.lower().str.split(), strict=True):
            n = _lcs(x, y)
            out.append(2 * n / (len(x) + len(y)) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return df.select(id_col, F.pandas_udf(score, "double")(F.col(original), F.col(made)).alias("rouge_l"))


def plugged(df: DataFrame, call, schema: str) -> DataFrame:
    """A model's client at the edge of the engine: call takes and gives pandas frames, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield call(b)

    return df.mapInPandas(run, schema)
