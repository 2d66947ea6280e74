"""Evaluation texts leaking into training text.

Method: one Aho-Corasick automaton over the normalised test items; every corpus text is scanned once, and
hits are mapped back to offsets in the original. Texts and items are reduced to their letters and digits
(case, markup, entities, escapes, spacing, invisible marks, accents, look-alike letters and wrongly
decoded bytes undone), so however a passage is spaced or dressed it is the same run of characters.

A run of `run` words holds a whole aligned block of (run + 1) // 2 words wherever it begins, so only the
aligned blocks of the items are put into the automaton; a hit is then extended to both sides by comparing
characters, and counts where at least `run` whole words of the item stand there between word edges of the
text. This finds every run, with a tenth of the patterns of all windows.

All items go into one automaton, which each Python worker builds once and keeps; the corpus is scanned
once and isn't shuffled. The items' size is summed before they are sent: beyond `most_chars` characters,
which bounds a worker's memory, they are split and the corpus is scanned once for each part.

What looks like a tag or comment is taken off whatever its length. Where it holds `run` words or more, it
may as well be text between two signs, so such a text is also read with these left in place.

Defined results: null or blank texts and items match nothing; an item of fewer than `run` words matches
nothing; repeated rows each come out; equal items each come out; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import map_arrow

# Letters of other scripts that look like Latin ones, lower case.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѐ": "e", "ø": "o", "ł": "l", "đ": "d", "ƅ": "b", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
}
_TABLE = str.maketrans(LOOK_ALIKE)

TAG = r"</?[A-Za-z][^<>]*>|<!--.*?-->"
ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10}\d{0,2});"
ESCAPE = r"\\u[0-9a-fA-F]{4}|\\[nrt]"
WRONG = r"[ÂÃâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}"
MARKUP = re.compile(f"{TAG}|{ENTITY}|{ESCAPE}|{WRONG}", re.S)
TAGS = re.compile(TAG, re.S)
ELEMENT = re.compile(f"{TAG}|{ENTITY}|{ESCAPE}|{WRONG}|.", re.S)
NOT_WORD = re.compile(r"[\W_]+")
_ASCII = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))
_DELETE = bytes(c for c in range(128) if not chr(c).isalnum())


def _unmark(m: re.Match) -> str:
    """What a piece of markup, an entity, an escape or wrongly decoded bytes stand for."""
    s = m.group(0)
    if s[0] == "<":
        return " "
    if s[0] == "&":
        return html.unescape(s)
    if s[0] == "\\":
        return chr(int(s[2:], 16)) if s[1] == "u" else " "
    if s[0] in "ÂÃâ" and len(s) > 1:
        for n in (len(s), 2):
            try:
                return b"".join(c.encode("cp1252") if ord(c) > 255 else c.encode("latin-1") for c in s[:n]).decode("utf-8") + s[n:]
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
    return s


def _plain(s: str) -> str:
    return unicodedata.normalize("NFKD", s).lower().translate(_TABLE)


def stream(text: str) -> str:
    """The letters and digits of a text, normalised."""
    if text.isascii() and "<" not in text and "&" not in text and "\\" not in text:
        return text.encode().translate(_ASCII, _DELETE).decode()
    return NOT_WORD.sub("", _plain(MARKUP.sub(_unmark, text)))


def located(text: str) -> tuple[str, list[int], list[bool]]:
    """The stream with, for each character, its offset in the text and whether a word begins there.
    One more entry of each marks the end."""
    out, at, begins = [], [], []
    edge = True
    for m in ELEMENT.finditer(text):
        s = m.group(0)
        piece = _plain(_unmark(m)) if len(s) > 1 else _plain(s)
        for c in piece:
            if c.isalnum():
                out.append(c)
                at.append(m.start())
                begins.append(edge)
                edge = False
            elif unicodedata.category(c) not in ("Mn", "Me", "Cf"):
                edge = True
    edge = True
    return "".join(out), [*at, len(text)], [*begins, edge]


class Items:
    """The items of one block and their automaton."""

    def __init__(self, items: list[tuple[str, str]], run: int):
        self.run = run
        self.streams: list[tuple[str, str, list[int]]] = []
        block = (run + 1) // 2
        patterns: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            s, _, begins = located(text)
            starts = [k for k, b in enumerate(begins[:-1]) if b]
            if len(starts) < run:
                continue
            n = len(self.streams)
            self.streams.append((item_id, s, [*starts, len(s)]))
            for w in range(0, len(starts) - block + 1, block):
                a, b = starts[w], (starts[w + block] if w + block < len(starts) else len(s))
                patterns.setdefault(s[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in patterns.items():
            self.automaton.add_word(p, (len(p), where))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def hits(self, text: str) -> dict[str, tuple[int, int, int]]:
        """Of each item with a run in the text: the words of its longest run, and the run's offsets."""
        found = self.read(text)
        if "<" in text and any(len(NOT_WORD.split(m.group(0))) >= self.run for m in TAGS.finditer(text)):
            opened = TAGS.sub(lambda m: m.group(0).replace("<", " ").replace(">", " ") if len(NOT_WORD.split(m.group(0))) >= self.run else m.group(0), text)
            for item, where in self.read(opened).items():  # signs became blanks: the offsets are those of the text
                if where[0] > found.get(item, (0,))[0]:
                    found[item] = where
        return found

    def read(self, text: str) -> dict[str, tuple[int, int, int]]:
        """hits, with tags and comments taken off."""
        if self.empty or next(self.automaton.iter(stream(text)), None) is None:
            return {}
        s, at, begins = located(text)
        found: dict[str, tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}  # of an item laid at a place: up to where it was compared
        for end, (length, where) in self.automaton.iter(s):
            first = end - length + 1
            for n, a in where:
                shift = first - a  # where the item would begin in the text
                if a < done.get((n, shift), 0):
                    continue
                item_id, own, starts = self.streams[n]
                lo, hi = a, a + length
                while lo > 0 and shift + lo > 0 and own[lo - 1] == s[shift + lo - 1]:
                    lo -= 1
                while hi < len(own) and shift + hi < len(s) and own[hi] == s[shift + hi]:
                    hi += 1
                done[n, shift] = hi
                i, j = bisect_left(starts, lo), bisect_right(starts, hi) - 1
                while i < j and not begins[shift + starts[i]]:
                    i += 1
                while j > i and not begins[shift + starts[j]]:
                    j -= 1
                if j - i >= self.run and j - i > found.get(item_id, (0,))[0]:
                    found[item_id] = (j - i, at[shift + starts[i]], at[shift + starts[j] - 1] + 1)
        return found


_built: dict[str, Items] = {}


def _items(key: str, items: list[tuple[str, str]], run: int) -> Items:
    """The automaton of a set of items, built once by each worker, which keeps the last one."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, run)
    return _built[key]


def _scanner(sent, run: int):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _items(key, sent.value, run)
        for batch in batches:
            corpus, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            rows = [(c, i, item, *where) for c, i, t in zip(corpus, ids, texts, strict=True) if t for item, where in own.hits(t).items()]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.int32()) for c in cols[3:])], names=["corpus", "rec_id", "item_id", "n_words", "start", "stop"])

    return scan


def leaks(texts: DataFrame, items: DataFrame, *, run: int = 10, most_chars: int = 16_000_000) -> DataFrame:
    """One row for each text and item with a run of at least `run` words of the item in the text: corpus,
    rec_id, item_id, n_words (of the longest run) and its offsets [start, stop) in the text.

    texts: corpus STRING, rec_id BIGINT, text STRING; items: item_id STRING, text STRING.
    """
    spark = texts.sparkSession
    chosen = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    n_parts = max(1, -(-(chosen.agg(F.sum(F.length("text"))).first()[0] or 0) // most_chars))
    out = None
    for k in range(n_parts):
        part = [(r.item_id, r.text) for r in chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k).collect()]  # at most about most_chars characters
        sent = spark.sparkContext.broadcast(part)
        found = map_arrow(texts.select("corpus", F.col("rec_id").cast("long"), "text"), _scanner(sent, run), "corpus string, rec_id long, item_id string, n_words int, start int, stop int")
        out = found if out is None else out.unionAll(found)
    return out


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """For each item: the records of each corpus that carry it, and the longest run; items that didn't
    leak come out with zeros and a null corpus."""
    counts = found.groupBy("corpus", "item_id").agg(F.countDistinct("rec_id").alias("n_records"), F.max("n_words").alias("longest_run"))
    return items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", "corpus", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))
