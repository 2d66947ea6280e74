"""Vocabularies: building, membership, coverage, frequency profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions.sequences import SPECIAL
from textquarry.functions.text import PLAIN_FROM, PLAIN_TO, TOKEN, plain_signs, strip, tokens, words
from textquarry.session import map_arrow

_TOKEN = re.compile(TOKEN, re.ASCII)
_PLAIN = str.maketrans(dict(zip(PLAIN_FROM, PLAIN_TO, strict=True)) | {"…": "..."})

# The marks that follow the special tokens in a vocabulary, in the order of their ids.
MARKS = (*".,!?;:-()\"'", *"0123456789", "\n")


def word_list(spark: SparkSession, path: str, variable: str = "__WORDS") -> DataFrame:
    """The words of a script's string literal, parted by |: distinct, lower-case ones in order."""
    literal = F.regexp_extract("value", variable + r'\s*=\s*"([^"]+)"', 1)
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.split(literal, r"\|")).alias("word"))
    return raw.select(strip("word").alias("word")).where(F.col("word").rlike(r"^[a-z]['a-z]*$")).distinct().orderBy("word")


def with_ids(word_df: DataFrame) -> DataFrame:
    """token, id: specials, marks, then the words in order. A vocabulary is a dimension of thousands."""
    head = [*SPECIAL, *MARKS]
    spark = word_df.sparkSession
    first = spark.createDataFrame([(t, i) for i, t in enumerate(head)], "token string, id int")
    rest = word_df.select(F.col("word").alias("token"), (F.row_number().over(Window.orderBy("word")) + len(head) - 1).alias("id"))
    return first.unionByName(rest)


def frequencies(df: DataFrame, text: str) -> DataFrame:
    """word, n; counted before the shuffle in every task."""
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent words, ties in order of the word."""
    return freq.orderBy(F.desc("n"), "word").limit(k)


def coverage(freq: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens and word forms in and out of a vocabulary, and the share out of it."""
    flagged = freq.join(vocab.select("word", F.lit(1).alias("_in")), "word", "left")
    known = F.col("_in").isNotNull()
    return flagged.agg(F.sum("n").alias("n_tokens"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("n_out"), F.count(F.when(~known, 1)).alias("forms_out")).withColumn("out_rate", F.col("n_out") / F.col("n_tokens"))


def _sent(vocab: DataFrame, most: int):
    """The vocabulary as a broadcast map from token to id, or None where it has more than `most` tokens."""
    rows = vocab.select("token", "id").limit(most + 1).collect()  # at most so many
    if len(rows) > most:
        return None
    return vocab.sparkSession.sparkContext.broadcast({r.token: r.id for r in rows})


def _plain(text: str | None) -> str:
    return (text or "").translate(_PLAIN)


def _validator(sent, n_texts: int, normalise: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            sizes, found = [], []
            for texts in zip(*(batch.column(k + 1).to_pylist() for k in range(n_texts)), strict=True):
                toks = [t for x in texts for t in _TOKEN.findall(_plain(x) if normalise else x or "")]
                sizes.append(len(toks))
                found.append([t for t in toks if t not in held and t.lower() not in held])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=[batch.schema.names[0], "n_tokens", "violations"])

    return run


def validated(df: DataFrame, id_col: str, texts: Sequence[str], vocab: DataFrame, *, normalise: bool = True, most: int = 1_000_000) -> DataFrame:
    """For each row the number of tokens of its texts (one, or a pair: those of the second follow those of
    the first) and the tokens outside the vocabulary in their order, repeats kept; typographic signs are
    made plain first. Marks and digits belong to every vocabulary (vocab: word). Null texts have no tokens.

    The vocabulary is counted: up to `most` words it goes to the workers and nothing is shuffled; a larger
    one is joined with the tokens (id_col must be unique then)."""
    tokens_of = with_ids(vocab)
    sent = _sent(tokens_of, most)
    if sent is not None:
        schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, violations array<string>"
        return map_arrow(df.select(id_col, *texts), _validator(sent, len(texts), normalise), schema)
    clean = lambda c: plain_signs(c) if normalise else F.col(c)
    nothing = F.expr("cast(array() as array<string>)")
    each = df.select(id_col, F.posexplode(F.concat(*(F.coalesce(tokens(clean(c)), nothing) for c in texts))).alias("pos", "tok"))
    low, raw = tokens_of.select(F.col("token").alias("_l")), tokens_of.select(F.col("token").alias("_r"))
    known = each.select("tok").distinct().join(low, F.lower("tok") == F.col("_l"), "left").join(raw, F.col("tok") == F.col("_r"), "left")
    flagged = each.join(known.select("tok", F.coalesce("_l", "_r").isNull().alias("out")), "tok")
    bad = F.transform(F.sort_array(F.collect_list(F.when(F.col("out"), F.struct("pos", "tok")))), lambda x: x["tok"])
    lists = flagged.groupBy(id_col).agg(F.count("*").alias("n_tokens"), bad.alias("violations"))
    return df.select(id_col).join(lists, id_col, "left").select(id_col, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("violations", nothing).alias("violations"))


def violations(df: DataFrame, id_col: str, text: str, vocab: DataFrame, **options: bool) -> DataFrame:
    """For each text its tokens, those outside the vocabulary, and the share inside (1 where it has no
    tokens)."""
    found = validated(df, id_col, [text], vocab, **({"normalise": False} | options))
    out = F.size("violations").cast("long")
    return found.select(id_col, "n_tokens", out.alias("n_out"), F.coalesce(1 - F.try_divide(out, F.col("n_tokens")), F.lit(1.0)).alias("inside_rate"))


def _encoder(sent, pieces: bool):
    def of(held: dict[str, int], token: str) -> list:
        low = token.lower()
        if low in held:
            return ["<CAP>", low] if len(token) > 1 and token[0].isupper() else [low]
        return [token] if token in held else ["<UNK>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = sent.value, {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                row = []
                for t in _TOKEN.findall(text or ""):
                    if t not in seen:
                        own = of(held, t)
                        seen[t] = own if pieces else [held[x] for x in own]
                    row += seen[t]
                rows.append(row)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.string() if pieces else pa.int32()))], names=[batch.schema.names[0], "pieces" if pieces else "ids"])

    return run


def encoded(df: DataFrame, id_col: str, text: str, vocab: DataFrame, *, pieces: bool = False, most: int = 1_000_000) -> DataFrame:
    """The ids (or the tokens themselves, as pieces) of a text in a vocabulary (token, id): a capitalised
    word of more than a letter is <CAP> and the word in lower case, an unknown one <UNK>; a null text is
    empty. Up to `most` tokens the vocabulary goes to the workers and nothing is shuffled; a larger one is
    joined with the distinct tokens (id_col must be unique then)."""
    sent, name = _sent(vocab, most), "pieces" if pieces else "ids"
    kind = "array<string>" if pieces else "array<int>"
    if sent is not None:
        return map_arrow(df.select(id_col, text), _encoder(sent, pieces), f"{id_col} {df.schema[id_col].dataType.simpleString()}, {name} {kind}")
    each = df.select(id_col, F.posexplode(tokens(F.col(text))).alias("pos", "tok"))
    value = F.col("token") if pieces else F.col("id")
    low, raw = vocab.select(F.col("token").alias("_l"), value.alias("low_id")), vocab.select(F.col("token").alias("_r"), value.alias("raw_id"))
    cap = F.col("tok").rlike(r"^\p{Lu}") & (F.length("tok") > 1)
    special = {k: F.lit(k if pieces else i) for i, k in enumerate(SPECIAL)}
    own = F.when(F.col("low_id").isNotNull() & cap, F.array(special["<CAP>"], F.col("low_id"))).otherwise(F.array(F.coalesce("low_id", "raw_id", special["<UNK>"])))
    table = each.select("tok").distinct().join(low, F.lower("tok") == F.col("_l"), "left").join(raw, F.col("tok") == F.col("_r"), "left").select("tok", own.alias("own"))
    seqs = each.join(table, "tok").groupBy(id_col).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"])).alias(name))
    return df.select(id_col).join(seqs, id_col, "left").select(id_col, F.coalesce(name, F.expr(f"cast(array() as {kind})")).alias(name))


def rank_frequency(freq: DataFrame, most: int = 200) -> DataFrame:
    """rank, word, n of the most frequent words."""
    head = top(freq, most)  # bounded, so the window is small
    return head.select(F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"), "word", "n")


def zipf_slope(freq: DataFrame, most: int = 200) -> DataFrame:
    """The slope of log frequency on log rank; 0 under five words."""
    r = rank_frequency(freq, most)
    return r.agg(F.when(F.count("*") >= 5, F.regr_slope(F.log("n"), F.log("rank"))).otherwise(0.0).alias("slope"))


def probe(freq: DataFrame, size: int) -> DataFrame:
    """Entropy of the words, the same over the log of the vocabulary's size, and the vocabulary used."""
    sums = freq.agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_forms"), F.sum(F.col("n") * F.log("n")).alias("_nlogn"))
    entropy = F.log("n_tokens") - F.col("_nlogn") / F.col("n_tokens")
    return sums.withColumn("entropy", entropy).withColumns({"normalised": F.col("entropy") / F.log(F.lit(float(size))), "used": F.col("n_forms") / size}).drop("_nlogn")
