"""Texts cut off by field limits.

Method: a corpus vocabulary and its trie of proper prefixes flag a text whose last token is an unknown
proper prefix of known words. Length evidence goes with it: for each source, open endings that heap up at
one length (in characters, bytes, words, or words and signs) beyond what chance leaves beside it betray a
field limit, and a text that ends openly at such a length was cut there.

A cut between words that lies at no limit (a transfer broken off) shows neither. For these rows the trie
is continued from the letters of a word to the words of a sentence: for every word in its frame (first two
words of the sentence, place among its first words, preceding word, word) it is counted how often a
complete sentence ends there and how often it goes on. Where these counts leave both readings possible,
it decides how often the source plainly cuts or plainly leaves out the full stop. The column `evidence`
names what decided about each row; cut_evidence reports the shares per source.

The trie is kept as a table of its nodes (prefix, number of words below) and probed by a join, so it may
outgrow any single machine. Counts are made over all texts, pre-aggregated per input partition. What a
word or an ending must reach to be known is a share of the corpus, so it holds at any size.

Defined results: null, blank and placeholder texts, and texts that are one <...> error, are never cases;
repeated rows are judged alike, each in its own right; an empty table gives an empty result; columns
other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import map_arrow, materialise

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.?!…]+|\n+|:")
END, BREAK, FIRST = 1, 2, 4
BULLET = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
CLOSERS = ")]}\"”’»'*_`"
MASK = np.uint64(0x9E3779B97F4A7C15)
SIGN = re.compile(r"\w+|[^\w\s]")
UNITS = ("chars", "bytes", "words", "signs")
#: Up to so many words, lengths are those of short answers and tell nothing of limits.
SHORT = 8


class Lexicon:
    """Token ids and word hashes of this worker; emptied when it holds too many words."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = [""] * FIRST
        self.hashes: list[int] = [0] * FIRST

    def of(self, token: str) -> int:
        k = self.ids.get(token)
        if k is None:
            if token[0] in "\n:" or "…" in token or "..." in token:
                k = BREAK
            elif token[0] in ".?!":
                k = END
            else:
                k = len(self.words)
                self.words.append(token)
                self.hashes.append(xxhash.xxh64_intdigest(token))
            self.ids[token] = k
        return k


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of a row of hashes, the same everywhere."""
    h = np.uint64(len(parts))
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, dtype=np.uint64)) * MASK
            h = h ^ (h >> np.uint64(29))
    return h


def _tokens(texts: list[str], lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, each followed by a break; and where each text ends."""
    if len(lex.words) > lex.limit:
        lex.clear()
    get, of, out, stops = lex.ids.get, lex.of, [], []
    for t in texts:
        out += [get(x) or of(x) for x in TOKEN.findall(t.lower())]
        stops.append(len(out))
        out.append(BREAK)
    return np.array(out, dtype=np.int64), np.array(stops, dtype=np.int64)


def _frames(arr: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words, and the key of each in its frame."""
    h = np.array(lex.hashes, dtype=np.uint64)
    at = np.arange(len(arr))
    start = np.maximum.accumulate(np.where(arr < FIRST, at + 1, 0))
    words = np.flatnonzero(arr >= FIRST)
    s, pos = start[words], words - start[words]
    cur, first = h[arr[words]], h[arr[s]]
    prev = np.where(pos > 0, h[arr[np.maximum(words - 1, 0)]], np.uint64(0))
    second = np.where(pos > 0, h[arr[np.minimum(s + 1, len(arr) - 1)]], np.uint64(0))
    framed = np.where(pos >= 2, _mix(first, second, prev, cur, np.minimum(pos, 6)), np.where(pos == 1, _mix(first, cur), _mix(cur)))
    return words, framed


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys and the sums of the values for each."""
    uniq, inverse = np.unique(keys, return_inverse=True)
    return [uniq, *(np.bincount(inverse, weights=v, minlength=len(uniq)).astype(np.int64) for v in values)]


STATS = "key long, word string, ends long, goes_on long"
_STATS_ARROW = pa.schema([("key", pa.int64()), ("word", pa.string()), ("ends", pa.int64()), ("goes_on", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of texts: for each frame how often a sentence ends or goes on, and the number of
    each word where something follows it."""
    lex, held, known, rows = Lexicon(), [], {}, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, known, rows
        if held:
            keys, ends, on = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.string()), pa.array(ends), pa.array(on)], schema=_STATS_ARROW)
        if known:
            n = len(known)
            yield pa.record_batch([pa.nulls(n, pa.int64()), pa.array(list(known), pa.string()), pa.nulls(n, pa.int64()), pa.array(list(known.values()), pa.int64())], schema=_STATS_ARROW)
        held, known, rows = [], {}, 0

    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        if not texts:
            continue
        arr, _ = _tokens(texts, lex)
        words, framed = _frames(arr, lex)
        after = arr[words + 1]
        ends, on = (after == END).astype(np.int64), (after >= FIRST).astype(np.int64)
        held.append(tuple(_sums(framed, ends, on)))
        counts = np.bincount(arr[words][after != BREAK], minlength=FIRST)
        for k in np.flatnonzero(counts):
            known[lex.words[k]] = known.get(lex.words[k], 0) + int(counts[k])
        rows += len(held[-1][0])
        if rows > 3_000_000:
            yield from flush()
    yield from flush()


TAILS = "corpus string, rec_id long, source string, kind string, last string, framed long, whole long, full long, n_chars int, n_bytes int, n_words int, n_signs int"
_TAILS_ARROW = pa.schema([("corpus", pa.string()), ("rec_id", pa.int64()), ("source", pa.string()), ("kind", pa.string()), ("last", pa.string()), ("framed", pa.int64()), ("whole", pa.int64()), ("full", pa.int64()), *((f"n_{u}", pa.int32()) for u in UNITS)])


def ending(text: str | None) -> tuple[str, str]:
    """What a text's end looks like, and the text without the marks after its last word.

    none: no content; error; stopped: ends with a full stop or the like; broken: ends in a damaged
    character; open: goes on by its mark (comma, dash); closed: in a bracket or quotation; list: in a list
    item; bare: in a word."""
    t = (text or "").rstrip("​﻿ \t\r\n\xa0")
    if not any(c.isalnum() for c in t):
        return ("broken" if t.endswith("�") else "none"), t
    if re.fullmatch(r"\s*<[^<>]*>", t) or re.fullmatch(r"\s*\[(?:empty|error)[^\[\]]*\]", t, re.I):
        return "error", t
    if t.endswith("�"):
        return "broken", t
    body = t.rstrip(CLOSERS + " ")
    shut = body != t
    if re.search(r"(?:\.\.\.|…)$", body):
        return "bare", re.sub(r"[.…\s]+$", "", body)
    if re.search(r"[.?!。！？]$", body):
        return "stopped", t
    if re.search(r"[,;–—-]$", body):
        return "open", body
    if shut:
        return "closed", body
    line = body[body.rfind("\n") + 1 :]
    m = BULLET.match(line)
    if m and len(line[m.end() :].split()) <= 5:
        return "list", body
    return "bare", body


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text that doesn't plainly stop: the look of its end, its last word and its keys."""
    lex = Lexicon()
    for batch in batches:
        corpus, ids, source, texts = (batch.column(k).to_pylist() for k in range(4))
        keep, kinds, bodies, lengths = [], [], [], []
        for i, t in enumerate(texts):
            kind, body = ending(t)
            if kind not in ("none", "error", "stopped"):
                keep.append(i)
                kinds.append(kind)
                bodies.append(body)
                lengths.append((len(t), len(t.encode("utf-8", "replace")), len(t.split()), len(SIGN.findall(t))))
        if not keep:
            continue
        parts = []
        for b in bodies:  # the last sentence; the whole text was read to find where it begins
            cut = max(b.rfind(x) for x in ("\n", ". ", "? ", "! ", ": ", "… "))
            parts.append(b[cut + 1 :] if cut >= 0 else b)
        arr, stops = _tokens(parts, lex)
        words, framed = _frames(arr, lex)
        owner = np.searchsorted(stops, words)
        last, key, whole = [None] * len(keep), [None] * len(keep), [None] * len(keep)
        running: dict[int, list[str]] = {}
        for o, w, f in zip(owner.tolist(), words.tolist(), framed.view(np.int64).tolist(), strict=True):
            last[o], key[o] = lex.words[arr[w]], f
            running.setdefault(o, []).append(lex.words[arr[w]])
        for o, ws in running.items():
            whole[o] = xxhash.xxh64_intdigest(" ".join(ws)) - (1 << 63)
        full = [xxhash.xxh64_intdigest(" ".join(b.lower().split())) - (1 << 63) for b in bodies]
        yield pa.record_batch(
            [pa.array([corpus[i] for i in keep], pa.string()), pa.array([ids[i] for i in keep], pa.int64()), pa.array([source[i] for i in keep], pa.string()), pa.array(kinds, pa.string()), pa.array(last, pa.string()), pa.array(key, pa.int64()), pa.array(whole, pa.int64()), pa.array(full, pa.int64()), *(pa.array(x, pa.int32()) for x in zip(*lengths, strict=True))],
            schema=_TAILS_ARROW,
        )


def judged(texts: DataFrame, *, rare: float = 1e-6, low: float = 0.02, share: float = 1e-3, chance: float = 0.002, sigmas: float = 6.0, excess: float = 5.0) -> DataFrame:
    """Every text without a plain stop, with the columns is_cut and evidence and what they rest on.

    texts: corpus STRING, rec_id BIGINT, source STRING, text STRING. rare: the share of all running words
    that a word must reach to be known (and it must recur). low: the share of sentence ends at a frame
    below which a text that ends there is cut. share: in which part of the different open endings a whole
    last sentence must recur to count as a way to end (copies of one text are one, those at a limit none),
    and at least five times as often as cuts at random would leave it, which befall a word with the
    probability `chance`; and in which part of the rows a short answer (of up to four words, or eight in a
    frame never seen) must recur to count as whole, unless it has two words or more and the last is
    unknown or such sentences plainly go on. sigmas, excess: how far the different open endings at one
    length of a source must lie above those around it, in deviations and as a multiple, for a limit.
    """
    counts = map_arrow(texts.select("text"), _count, STATS).groupBy("key", "word").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    counts = materialise(counts, "frames")
    frames = counts.where("key is not null").select("key", "ends", "goes_on")
    running = counts.where("word is not null").agg(F.sum("goes_on")).first()[0] or 0
    vocabulary = counts.where("word is not null").select("word", F.col("goes_on").alias("n")).where(F.col("n") >= max(2.0, rare * running))
    trie = (
        vocabulary.where(F.length("word") > 1)
        .select(F.explode(F.expr("transform(sequence(1, length(word) - 1), k -> left(word, k))")).alias("last"))
        .groupBy("last")
        .agg(F.count("*").alias("words_below"))
    )
    tails = materialise(map_arrow(texts.select("corpus", "rec_id", "source", "text"), _tails, TAILS).withColumn("source_key", F.coalesce("source", F.lit("\0"))), "tails")
    worded = tails.where("last is not null")
    few = max(5.0, share * worded.count())
    out = worded
    for unit in UNITS:
        out = out.join(_heaps(worded, unit, sigmas, excess), ["corpus", "source_key", f"n_{unit}"], "left")
    at_limit = F.coalesce(*(F.col(f"limit_{u}") for u in UNITS), F.lit(False)) & (F.col("n_words") > SHORT)
    out = out.withColumn("at_limit", at_limit).drop(*(f"limit_{u}" for u in UNITS))
    texts_of = out.groupBy("whole", "full").agg(F.count("*").alias("rows"), F.count_if(~F.col("at_limit")).alias("free"))
    wholes = texts_of.groupBy("whole").agg(F.count_if(F.col("free") > 0).alias("recurs"), F.sum("rows").alias("copies"))
    out = (
        out.join(frames.withColumnRenamed("key", "framed"), "framed", "left")
        .join(vocabulary.withColumnRenamed("word", "last"), "last", "left")
        .join(trie, "last", "left")
        .join(wholes, "whole", "left")
    )
    out = out.withColumn("p", _end_share(few)).withColumn("_clear", _clear(low, few, chance)).withColumns({"clear": F.col("_clear.cut"), "evidence": F.coalesce("_clear.by", F.lit("habit"))}).drop("_clear")
    habits = out.groupBy("corpus", "source_key").agg(F.count(F.when(F.col("clear"), 1)).alias("clear_cut"), F.count(F.when(~F.col("clear"), 1)).alias("clear_whole"))
    odds = ((F.col("clear_cut") + 1) / (F.col("clear_whole") + 1)) * ((1 - F.col("p")) / F.col("p"))
    out = out.join(habits, ["corpus", "source_key"]).withColumn("is_cut", F.coalesce("clear", odds > 1, F.lit(False))).drop("source_key")
    bare = tails.where("last is null").drop("source_key").withColumns({"is_cut": F.col("kind").isin("broken", "open"), "evidence": F.lit("mark")})
    return out.unionByName(bare, allowMissingColumns=True)


def _heaps(tails: DataFrame, unit: str, sigmas: float, excess: float) -> DataFrame:
    """The lengths of each source at which different open endings heap up."""
    n = F.col(f"n_{unit}")
    w = Window.partitionBy("corpus", "source_key").orderBy(n)
    beside = (F.sum("here").over(w.rangeBetween(-24, 24)) - F.sum("here").over(w.rangeBetween(-4, 4))) / 40
    return (
        tails.groupBy("corpus", "source_key", n)
        .agg(F.countDistinct("whole").alias("here"))
        .withColumn("around", F.greatest(beside, F.lit(0.5)))
        .where((F.col("here") > F.col("around") + sigmas * F.sqrt("around")) & (F.col("here") >= excess * F.col("around")))
        .select("corpus", "source_key", n, F.lit(True).alias(f"limit_{unit}"))
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _end_share(few: float) -> Column:
    """The share of sentence ends among what follows the last frame; null where it was never seen."""
    ends = _zero("ends") + F.when(_zero("recurs") >= few, _zero("recurs")).otherwise(0)
    return F.try_divide(ends, ends + _zero("goes_on"))


def _clear(low: float, few: float, chance: float) -> Column:
    """Whether a text is plainly cut or plainly whole, and by which evidence; null where the source's
    habits must decide."""
    p = F.col("p")
    unknown = F.col("n").isNull() & (_zero("words_below") > 0)
    many = _zero("copies") >= few
    by = lambda cut, name: F.struct((F.lit(cut) if isinstance(cut, bool) else cut).alias("cut"), F.lit(name).alias("by"))
    return (
        F.when(F.col("kind").isin("broken", "open"), by(True, "mark"))
        .when(F.col("kind") == "closed", by((_zero("ends") == 0) & (_zero("goes_on") >= 20), "sentence"))
        .when(many & (F.col("n_words") == 1) & (_zero("copies") >= 5 * chance * _zero("goes_on")), by(False, "answer"))  # one word has no frame to tell
        .when(unknown, by(True, "prefix"))
        .when(many & (F.col("n_words") <= F.when(p.isNull(), SHORT).otherwise(4)) & ~F.coalesce(p < low, F.lit(False)), by(False, "answer"))  # a short answer that many give
        .when(F.col("kind") == "list", by(False, "list"))
        .when((_zero("recurs") >= few) & (_zero("recurs") >= 5 * chance * _zero("goes_on")), by(False, "ending"))
        .when(F.col("at_limit") & ~F.coalesce(p >= 0.9, F.lit(False)), by(True, "length"))
        .when(p < low, by(True, "sentence"))
        .when(p >= 0.9, by(False, "sentence"))
        .when(p.isNull(), by(_zero("words_below") > 0, "prefix"))
    )


def cut_texts(texts: DataFrame, **options: float) -> DataFrame:
    """The rows whose text was cut off: corpus, rec_id, source."""
    return judged(texts, **options).where("is_cut").select("corpus", "rec_id", "source")


def cut_evidence(texts: DataFrame, **options: float) -> DataFrame:
    """Of the cut rows of each source of each corpus: how many were decided by which evidence (mark,
    prefix, length, sentence, habit)."""
    return judged(texts, **options).where("is_cut").groupBy("corpus", "source", "evidence").agg(F.count("*").alias("n_cut"))


def cut_rates(texts: DataFrame, **options: float) -> DataFrame:
    """How often each source of each corpus cuts: rows with content, cut rows and their share. Rows
    without a source come out under a null source."""
    cut = cut_texts(texts, **options).groupBy("corpus", "source").agg(F.count("*").alias("n_cut"))
    all_rows = texts.where(F.col("text").rlike(r"[\p{L}\p{N}]")).groupBy("corpus", "source").agg(F.count("*").alias("n_rows"))
    joined = all_rows.alias("a").join(cut.alias("c"), (F.col("a.corpus") == F.col("c.corpus")) & F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    n = F.coalesce("c.n_cut", F.lit(0))
    return joined.select("a.corpus", "a.source", "n_rows", n.alias("n_cut"), (n / F.col("n_rows")).alias("cut_rate"))
