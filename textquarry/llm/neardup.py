"""Near-duplicate records with small edits.

Method: min-max hashing. A text is the set of its distinct runs of `shingle` words. Under each of
`permutations` random functions both the smallest and the largest value over the set are kept, so a
signature of twice that length costs as many hash evaluations as it has permutations. Bands of `rows`
signature values are buckets; texts that share a bucket are candidates and are compared exactly.

Exact copies are folded first (one text per distinct text in lower case), so a crowd of copies meets the
buckets once; members are joined back at the end. Nothing is collected: buckets meet in a sort-merge
join, which spills and which adaptive execution splits where one bucket holds a large share of rows.

Defined results: null, blank and short texts (under `min_words` words) have no partner; repeated rows are
partners of each other; equal ids in two rows don't pair with themselves; empty tables give empty
results; other columns are ignored. A pair of similarity J is missed with the probability
(1 - J^rows)^bands, for the production parameters 0.055 at J = 0.6, 0.005 at 0.67, 0.00006 at 0.75.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import discard, map_arrow, materialise

WORD = re.compile(r"[^\W_]+")
WORD_JVM = r"[\p{L}\p{N}]+"


class WordHashes:
    """Hashes of words, kept per worker and emptied at `limit`."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.of = limit, {}

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts, and the number of words of each text."""
        if len(self.of) > self.limit:
            self.of.clear()
        of, out, counts = self.of, [], []
        for t in texts:
            words = WORD.findall((t or "").lower())
            counts.append(len(words))
            try:
                out += [of[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in of:
                        of[w] = xxhash.xxh64_intdigest(w)
                out += [of[w] for w in words]
        return np.array(out, dtype=np.uint64), np.array(counts, dtype=np.int64)


def _blend(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, text after text, and the number of runs of each text."""
    runs = np.maximum(counts - k + 1, 0)
    if not runs.sum():
        return np.empty(0, np.uint64), runs
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
        h = _blend(h)
    starts = np.repeat(np.cumsum(counts) - counts, runs)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(runs) - runs, runs)
    return h[starts + within], runs


def _signer(shingle: int, min_words: int, permutations: int, rows: int, seed: int):
    """A function for mapInArrow: (key, text) -> one row (bucket, key) for each band of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        mult = rng.integers(1, 2**32, permutations, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, permutations, dtype=np.uint32)
        n_bands = 2 * permutations // rows
        salt = _blend(np.arange(1, n_bands + 1, dtype=np.uint64))
        lookup = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):  # bounds the arrays of a batch
                batch = whole.slice(at, 2000)
                words, counts = lookup.ids(batch.column(1).to_pylist())
                sh, runs = shingles(words, counts, shingle)
                ok = (counts >= min_words) & (runs > 0)
                if not ok.any():
                    continue
                sh = (sh[np.repeat(ok, runs)] >> np.uint64(32)).astype(np.uint32)  # well mixed, so half of it will do
                runs = runs[ok]
                first = np.cumsum(runs) - runs
                sig = np.empty((len(runs), 2 * permutations), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for p in range(permutations):
                        v = sh * mult[p] + add[p]
                        sig[:, 2 * p] = np.minimum.reduceat(v, first)
                        sig[:, 2 * p + 1] = np.maximum.reduceat(v, first)
                    bands = np.zeros((len(runs), n_bands), dtype=np.uint64)
                    for r in range(rows):
                        bands = (bands ^ sig[:, r : n_bands * rows : rows]) * np.uint64(0x9E3779B97F4A7C15)
                        bands ^= bands >> np.uint64(29)
                    bands = bands + salt
                keys = batch.column(0).to_numpy(zero_copy_only=False)[ok]
                yield pa.record_batch([pa.array(bands.ravel().view(np.int64)), pa.array(np.repeat(keys, n_bands))], names=["bucket", "key"])

    return run


def _verifier(shingle: int, threshold: float):
    """A function for mapInArrow: (a, b, text_a, text_b) -> the pairs that are alike enough, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n = batch.num_rows
                sides = []
                for c in (2, 3):
                    words, counts = lookup.ids(batch.column(c).to_pylist())
                    sh, runs = shingles(words, counts, shingle)
                    row = np.repeat(np.arange(n), runs)
                    order = np.lexsort((sh, row))
                    sh, row = sh[order], row[order]
                    new = np.ones(len(sh), dtype=bool)
                    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
                    sides.append((sh[new], row[new]))
                sh, row = np.concatenate([sides[0][0], sides[1][0]]), np.concatenate([sides[0][1], sides[1][1]])
                order = np.lexsort((sh, row))
                sh, row = sh[order], row[order]
                both = np.bincount(row[1:][(sh[1:] == sh[:-1]) & (row[1:] == row[:-1])], minlength=n)
                union = np.bincount(row, minlength=n) - both
                score = both / np.maximum(union, 1)
                ok = score >= threshold - 1e-12
                yield pa.record_batch([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(score[ok])], names=["a", "b", "similarity"])

    return run


def fold(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies folded: members (id, key) and texts (key, text), one for each distinct text in lower
    case. Texts too short for min_words words by their length alone are left out here."""
    keyed = df.where(F.length(text_col) >= 2 * min_words - 1).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lower(text_col)).alias("key"), F.col(text_col).alias("text"))
    return keyed.select("id", "key"), keyed.groupBy("key").agg(F.first("text").alias("text"))


def long_enough(texts: DataFrame, min_words: int) -> DataFrame:
    """The texts of at least min_words words."""
    return texts.where(F.size(F.regexp_extract_all(F.lower("text"), F.lit(WORD_JVM), F.lit(0))) >= min_words)


def text_links(texts: DataFrame, *, shingle: int = 5, threshold: float = 0.8, min_words: int = 1, permutations: int = 90, rows: int = 5, seed: int = 17) -> DataFrame:
    """The pairs of different texts (key, text) that are alike enough: a < b, and their similarity."""
    buckets = map_arrow(texts, _signer(shingle, min_words, permutations, rows, seed), "bucket long, key long")
    left, right = buckets.select("bucket", F.col("key").alias("a")), buckets.select("bucket", F.col("key").alias("b"))
    candidates = left.join(right, "bucket").where("a < b").select("a", "b").distinct()
    with_a = candidates.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return map_arrow(with_both.select("a", "b", "text_a", "text_b"), _verifier(shingle, threshold), "a long, b long, similarity double")


def similar_pairs(df: DataFrame, id_col: str, text_col: str, *, min_words: int = 1, **options: float) -> DataFrame:
    """All pairs of rows (rec_a < rec_b) whose texts are alike enough, copies included."""
    members, texts = fold(df, id_col, text_col, min_words)
    links = text_links(texts, min_words=min_words, **options).select("a", "b")
    left, right = members.select(F.col("id").alias("x"), F.col("key").alias("a")), members.select(F.col("id").alias("y"), F.col("key").alias("b"))
    between = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
    repeated = members.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key")
    eligible = long_enough(texts.join(repeated, "key", "left_semi"), min_words).select(F.col("key").alias("a"))
    copies = left.join(eligible, "a", "left_semi").join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("rec_a"), F.col("y").alias("rec_b"))
    return between.where("rec_a < rec_b").unionAll(copies).distinct()


def _state(edges: DataFrame) -> tuple:
    """The number of the edges and a sum over their hashes: equal where the edges are."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The smallest key linked with each node, over any number of links: (key, class_id).

    Large-star/small-star contraction: every round links nodes with the smallest neighbour seen, so a
    chain halves; each round is written to the shared folder and replaces the one before, until a round
    changes nothing."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before, now = None, _state(e)
    while now != before:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e, old = materialise(small, "edges"), e
        discard(old)
        before, now = now, _state(e)
    labels = e.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("class"))
    return nodes.join(labels, "key", "left").select("key", F.coalesce("class", "key").alias("class_id"))


def groups(df: DataFrame, id_col: str, text_col: str, *, min_words: int = 1, **options: float) -> DataFrame:
    """One row for each row of df that has a text of enough words: rec_id, class_id (the smallest id of
    its group), class_size, and n_links (rows whose text is alike, copies included)."""
    members, texts = fold(df, id_col, text_col, min_words)
    links = materialise(text_links(texts, min_words=min_words, **options).select("a", "b"), "links")
    copies = members.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("low"))
    keep = materialise(long_enough(texts, min_words).select("key"), "keys")
    classes = _components(links, keep)
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(copies.select(F.col("key").alias("b"), "copies"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("copies").alias("far"))
    keyed = copies.join(classes, "key").join(far, "key", "left")
    sizes = keyed.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.min("low").alias("head"))
    named = keyed.join(sizes, "class_id").select("key", F.col("head").alias("class_id"), "class_size", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(named, "key").select(F.col("id").alias("rec_id"), "class_id", "class_size", "n_links")
