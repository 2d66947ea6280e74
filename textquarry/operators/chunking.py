"""Chunks, turns and sections of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import bound, is_artifact, split_words, strip, strip_markdown


def overlapping(text: Column, most: int = 500, overlap: int = 50) -> Column:
    """Chunks of whole paragraphs, of at most `most` words where paragraphs allow, each beginning with the
    last `overlap` words of the one before. A paragraph longer than that stays whole. A fold inside the
    row: nothing is shuffled."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: strip(p)), lambda p: (p != "") & ~is_artifact(p))
    lists = F.transform(paragraphs, lambda p: split_words(strip_markdown(p)))
    empty = F.expr("cast(array() as array<string>)")
    start = F.struct(empty.alias("out"), empty.alias("cur"))

    def step(st: Column, ws: Column) -> Column:
        full = (F.size(st["cur"]) + F.size(ws) > most) & (F.size(st["cur"]) > 0)
        kept = F.when(F.size(st["cur"]) > overlap, F.slice(st["cur"], -overlap, overlap)).otherwise(empty) if overlap > 0 else empty
        return F.when(full, F.struct(F.concat(st["out"], F.array(F.array_join(st["cur"], " "))).alias("out"), F.concat(kept, ws).alias("cur"))).otherwise(F.struct(st["out"].alias("out"), F.concat(st["cur"], ws).alias("cur")))

    return bound(F.aggregate(lists, start, step), lambda done: F.when(F.size(done["cur"]) > 0, F.concat(done["out"], F.array(F.array_join(done["cur"], " ")))).otherwise(done["out"]))


def _grouped(units: Column, most: int, target: int | None) -> Column:
    """Units (text, n) joined in order: a group is closed before a unit that would make it too long, or as
    soon as it has the target's words."""
    empty = F.expr("cast(array() as array<struct<text: string, n: int>>)")
    start = F.struct(empty.alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(st: Column, u: Column) -> Column:
        full = (st["n"] > 0) & (st["n"] + u["n"] > most)
        group = F.array(F.struct(st["cur"].alias("text"), st["n"].alias("n")))
        out = F.when(full, F.concat(st["out"], group)).otherwise(st["out"])
        cur = F.when(full | (st["n"] == 0), u["text"]).otherwise(F.concat(st["cur"], F.lit(" "), u["text"]))
        grown = F.struct(out.alias("out"), cur.alias("cur"), F.when(full, u["n"]).otherwise(st["n"] + u["n"]).alias("n"))
        if target is None:
            return grown
        shut = lambda g: F.when(g["n"] >= target, F.struct(F.concat(g["out"], F.array(F.struct(g["cur"].alias("text"), g["n"].alias("n")))).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))).otherwise(g)
        return bound(grown, shut)

    return bound(F.aggregate(units, start, step), lambda done: F.when(done["n"] > 0, F.concat(done["out"], F.array(F.struct(done["cur"].alias("text"), done["n"].alias("n"))))).otherwise(done["out"]))


def _counted(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.size(split_words(t)).alias("n")))


def targeted(text: Column, target: int = 350, least: int = 120, most: int = 600) -> Column:
    """Chunks of about `target` words, those outside [least, most] left out; a paragraph longer than
    `most` is parted at its sentences first."""
    tidy = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.array_join(split_words(p), " ")), lambda p: p != "")
    parted = lambda u: F.when(u["n"] <= most, F.array(u)).otherwise(_grouped(_counted(F.split(u["text"], r'(?<=[.!?])\s+(?=[A-Z"])')), most, None))
    units = F.flatten(F.transform(_counted(tidy), parted))
    return F.transform(F.filter(_grouped(units, most, target), lambda c: c["n"].between(least, most)), lambda c: c["text"])


def _begun(df: DataFrame, id_col: str, lines: Column, opens: Callable[[Column], Column], part: Callable[[Column, Column], Column]) -> DataFrame:
    """One row (id, n, part) for each stretch of lines that begins with one that opens it, all inside the
    row: nothing is shuffled. part takes the opening line and the lines after it."""

    def of(ls: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1))), lambda i: F.coalesce(opens(F.get(ls, i - 1)), F.lit(False)))
        stop = lambda hs, k: F.coalesce(F.get(hs, k + 1), F.size(ls) + 1)
        return bound(heads, lambda hs: F.transform(hs, lambda h, k: part(F.get(ls, h - 1), F.slice(ls, h + 1, stop(hs, k) - h - 1))))

    return df.select(id_col, F.posexplode(bound(lines, of)).alias("n", "p")).select(id_col, (F.col("n") + 1).cast("long").alias("n"), "p.*")


def turns(df: DataFrame, id_col: str, text: str, opener: str) -> DataFrame:
    """Turns of a dialogue: a line that the opener matches (its first group is the speaker) begins one,
    other lines continue it; lines before the first are left out. id, turn, speaker, text."""
    lines = F.filter(F.split(text, r"\n"), lambda x: strip(x) != "")
    body = lambda x: strip(F.regexp_replace(x, opener, ""))
    speaker = lambda x: F.regexp_extract(x, opener, 1)
    part = lambda head, rest: F.struct(speaker(head).alias("speaker"), F.array_join(F.concat(F.array(body(head)), F.transform(rest, body)), " ").alias("text"))
    return _begun(df, id_col, lines, lambda x: speaker(x) != "", part).withColumnRenamed("n", "turn")


def sections(df: DataFrame, id_col: str, text: str, header: str) -> DataFrame:
    """Sections that begin with a line the header's pattern matches: id, section, title, body, n_lines."""
    part = lambda head, rest: F.struct(strip(head).alias("title"), strip(F.array_join(rest, "\n")).alias("body"), F.size(rest).cast("long").alias("n_lines"))
    return _begun(df, id_col, F.split(text, r"\n"), lambda x: x.rlike(header), part).withColumnRenamed("n", "section")


def neighbours(df: DataFrame, doc: str, order: str, speaker: str, text: str, low: int, high: int, filter_first: bool = False) -> DataFrame:
    """Pairs of consecutive turns of different speakers, both within the length band. filter_first drops
    turns out of band before pairing, so others become neighbours."""
    band = F.char_length(text).between(low, high)
    src = df.where(band) if filter_first else df
    w = Window.partitionBy(doc).orderBy(order)
    nxt = src.withColumn("_n", F.lead(F.struct(speaker, text)).over(w))
    return nxt.where(band & (F.col(f"_n.{speaker}") != F.col(speaker)) & F.char_length(f"_n.{text}").between(low, high)).select(doc, order, F.col(speaker).alias("speaker_a"), F.col(text).alias("turn_a"), F.col(f"_n.{speaker}").alias("speaker_b"), F.col(f"_n.{text}").alias("turn_b"))


def pair_ids(df: DataFrame, doc: str, order: str, label: str = "pair") -> DataFrame:
    """Numbered ids within each document."""
    w = Window.partitionBy(doc).orderBy(order)
    return df.withColumn("pair_id", F.concat_ws("_", F.col(doc).cast("string"), F.lit(label), F.format_string("%03d", F.row_number().over(w))))


# The patterns of a scholastic article: its header, its title, an objection and a reply.
ARTICLE = r"(?m)^(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)\s+ARTICLE\b.*?\[I,\s*Q\.\s*(\d+),\s*Art\.\s*(\d+)\]"
TITLE = r"(?m)^(Whether\s+.+?\?)\s*$"
OBJECTION = r"(?ms)^(?:Objection|Obj\.)\s+(\d+):\s*(.+?)(?=\n\s*(?:Obj\.|Objection|_On the contrary,_|Reply Obj\.|_{23}))"
REPLY = r"(?ms)^Reply\s+Obj\.\s+(\d+):\s*(.+?)(?=\n\s*(?:Reply Obj\.|_{23}|^[A-Z]+\s+ARTICLE|\z))"


def articles(text: Column) -> Column:
    """The headers of the articles of a text: array of (question, article)."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1)).alias("question"), F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(2)).alias("article"))


def titles(text: Column) -> Column:
    """The titles in a text: lines that begin with Whether and end in a question mark."""
    return F.regexp_extract_all(text, F.lit(TITLE), F.lit(1))


def objections(text: Column) -> Column:
    """The numbered objections of an article: array of (n, text)."""
    return _numbered(text, OBJECTION)


def replies(text: Column) -> Column:
    """The numbered replies of an article: array of (n, text)."""
    return _numbered(text, REPLY)


def _numbered(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("text"))


def answered(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Objections beside their replies; of equal numbers the later one counts."""
    obj = df.select(*keys, F.posexplode(objections(F.col(text))).alias("pos", "o")).groupBy(*keys, F.col("o.n").cast("int").alias("n")).agg(F.max_by("o.text", "pos").alias("objection"))
    rep = df.select(*keys, F.posexplode(replies(F.col(text))).alias("pos", "r")).groupBy(*keys, F.col("r.n").cast("int").alias("n")).agg(F.max_by("r.text", "pos").alias("reply"))
    return obj.join(rep, [*keys, "n"])
