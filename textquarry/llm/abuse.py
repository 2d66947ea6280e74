"""Abusive, hateful or sexual content.

Method: subword bags. A passage is the bag of its words, their character n-grams and its word pairs, all
hashed into one table of embeddings; their mean goes through a linear softmax. Table and softmax are
trained jointly in numpy on reviewed documents, so a misspelt or disguised word is read by the n-grams
that it shares with its kin.

Reviews are of whole documents, so the passages of an abusive one aren't told apart at first: after each
round of training, its passages are judged anew and only those that look abusive (at least the highest)
stay positive. A document whose reviews the model flatly contradicts is left out of the next round, for
reviews hold mistakes. A document's score is that of its highest passage. The cutoff is the one that
agrees best with the reviews of held-out documents.

The classifier is fitted on at most `max_documents` reviewed documents (chosen by a hash of the id; the
bound is the only sample in this module), on the driver; every document is scored, in whole. The model
sent to the workers is one number per bucket: 2 ** bits * 4 bytes, 1 MB.

Defined results: a null or blank document scores 0; null reviews are ignored; contradicting reviews count
by their share; without reviews of both kinds the score is null and nothing is found; repeated rows score
alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.leakage import LOOK_ALIKE, MARKUP, _unmark
from textquarry.llm.mixing import source_name
from textquarry.session import map_arrow

# Signs that stand for letters inside a word.
SIGNS = {"@": "a", "4": "a", "3": "e", "€": "e", "1": "i", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"}
_LOOK = str.maketrans(LOOK_ALIKE)
_SIGN = re.compile(r"(?<=[a-z])[@43€1!|0$57+]+(?=[a-z])|(?<![\w@$!+|])[@43€1!|0$57+](?=[a-z]{2})|(?<=[a-z])[@430$57]+(?![\w@$!+|])")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*·]){3,}[^\W\d_](?!\w)")
LONG = re.compile(r"([^\W\d_])\1{2,}")
TOKEN = re.compile(r"[^\W_]+(?:[*'’#%]+[^\W_]*)*|[*#]{2,}[^\W_]*|[?!]")
SPLIT = re.compile(r"([.?!…][\"'”’)\]]*)\s+")
TOKEN_OR_END = re.compile(TOKEN.pattern + r"|\n")
DISGUISED = re.compile(r"[@€$|+\d]|![a-z]")
LABELS = re.compile(r"(?m)^\s*(?:>|[-*•]\s|\d+[.)]\s)|[A-ZÀ-Þ][A-ZÀ-Þ ]:")
UNSPACED = re.compile(r"([\u3040-\u30ff\u3400-\u9fff])")  # scripts without blanks: each sign is a word
LABEL = re.compile(r"^\s*(?:>\s*)*(?:[-*•]\s+|\d+[.)]\s+)?(?:[A-ZÀ-Þ][A-ZÀ-Þ ]{1,20}:\s+)?")


def normalised(text: str) -> str:
    """A text with a line for each sentence or line, normalised: marks, look-alikes, disguising signs,
    spread letters and stretched ones undone, labels taken off."""
    if not text.isascii() or "<" in text or "&" in text:
        text = unicodedata.normalize("NFKD", MARKUP.sub(_unmark, text))
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")) if not text.isascii() else text
        if not text.isascii():
            text = UNSPACED.sub(r" \1 ", text)
    text = SPLIT.sub(r"\1\n", text)
    if LABELS.search(text):
        text = "\n".join([LABEL.sub("", x, count=1) for x in text.split("\n")])
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LOOK)
    signs = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = signs >= 97
    apart = letter[:-2] & ~letter[1:-1] & letter[2:]
    if len(apart) > 4 and (apart[:-4] & apart[2:-2] & apart[4:]).any():
        text = SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group(0)), text)
    if DISGUISED.search(text):
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m.group(0)), text)
    if (letter[2:] & (signs[2:] == signs[1:-1]) & (signs[2:] == signs[:-2])).any():
        text = LONG.sub(r"\1", text)
    return text


def passages(text: str, longest: int = 40) -> list[list[str]]:
    """The sentences and lines as words; one of under two words joins its neighbour, long ones are taken in
    overlapping stretches."""
    out: list[list[str]] = []
    waiting: list[str] = []
    tokens = TOKEN_OR_END.findall(normalised(text))
    tokens.append("\n")
    at = 0
    while at < len(tokens):
        end = tokens.index("\n", at)
        words = tokens[at:end]
        at = end + 1
        if not words:
            continue
        if len(words) < 8 and sum(w[0].isalpha() for w in words) < 2:
            if out:
                out[-1] = out[-1] + words
            else:
                waiting += words
            continue
        out.append(waiting + words if waiting else words)
        waiting = []
    if waiting:
        out.append(waiting)
    if max(map(len, out), default=0) <= longest:
        return out
    return [words[k : k + longest] for words in out for k in range(0, max(len(words) - longest // 2, 1), longest // 2)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two word hashes."""
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))


class Words:
    """The words met by a worker: of each its buckets (itself and its character n-grams) and its hash, and
    with weights the sum of the weights of its buckets. Emptied at `limit` words, between batches. The
    first entry marks the edges of a passage."""

    def __init__(self, bits: int, weights: np.ndarray | None = None, limit: int = 300_000):
        self.mask, self.weights, self.limit = (1 << bits) - 1, weights, limit
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.ids: list[list[int]] = [[]]
        self.hash, self.sum, self.size = [1], [0.0], [0]

    def index(self, w: str) -> int:
        k = self.of.get(w)
        if k is None:
            b = f"<{w}>".encode()
            grams = {b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)}
            ids = [zlib.crc32(b"w" + b) & self.mask, *sorted(zlib.crc32(b"g" + g) & self.mask for g in grams)]
            k = self.of[w] = len(self.hash)
            self.hash.append(zlib.crc32(b) << 16 ^ zlib.adler32(b))
            self.size.append(len(ids))
            if self.weights is None:
                self.ids.append(ids)
            else:
                self.sum.append(float(self.weights[ids].sum()))
        return k

    def flat(self, parts: list[list[str]]) -> np.ndarray:
        """All words of the passages, an edge before each and one at the end."""
        if len(self.hash) > self.limit:
            self.clear()
        get, index, out = self.of.get, self.index, [0]
        for words in parts:
            out += [get(w) or index(w) for w in words]
            out.append(0)
        return np.array(out, dtype=np.int64)

    def pairs(self, flat: np.ndarray) -> np.ndarray:
        """The bucket of each word with the one after it, edges included."""
        h = np.array(self.hash, dtype=np.uint64)[flat]
        return (_mixed(h[:-1], h[1:]) & np.uint64(self.mask)).astype(np.int64)

    def logits(self, parts: list[list[str]], bias: float) -> np.ndarray:
        """The mean weight of each passage's buckets, and the bias."""
        flat = self.flat(parts)
        edge = np.flatnonzero(flat == 0)[:-1]
        total = np.add.reduceat(np.array(self.sum)[flat[:-1]] + self.weights[self.pairs(flat)], edge)
        return total / np.add.reduceat(np.array(self.size)[flat[:-1]] + 1, edge) + bias


@dataclass
class Model:
    """One weight per bucket, the bias, and the cutoff."""

    weights: np.ndarray
    bias: float
    cutoff: float
    bits: int
    agreement: float = 0.0


@dataclass
class Bags:
    """Passages as words: `flat` holds an edge before each passage and its words, `pairs` the bucket of each
    word with the one after it, `starts` and `lengths` where a passage lies; `doc` its document. `grams`
    and `gram_starts` hold the buckets of each word, those of the edge being the one spare bucket."""

    flat: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray

    @property
    def gram_sizes(self) -> np.ndarray:
        return np.diff(self.gram_starts)


def bags_of(texts: list[str], bits: int) -> Bags:
    """The passages of documents, in their order."""
    words, flat, pairs, lengths, doc = Words(bits, limit=1 << 62), [], [], [], []
    for k, text in enumerate(texts):
        parts = passages(text)
        if parts:
            own = words.flat(parts)
            flat.append(own[:-1])
            pairs.append(words.pairs(own))
            lengths += [len(p) + 1 for p in parts]
            doc += [k] * len(parts)
    spare = [[1 << bits], *words.ids[1:]]
    sizes = np.array(lengths, dtype=np.int64)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return Bags(join(flat), join(pairs), np.cumsum(sizes) - sizes, sizes, np.array(doc, dtype=np.int64), np.array([b for ids in spare for b in ids], dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in spare])]))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of spans, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Trainer:
    """Embeddings and softmax in training. A passage's vector is the mean of the embeddings of its buckets:
    those of its words and their n-grams, summed once per word of a batch, and those of its word pairs."""

    def __init__(self, bags: Bags, label: np.ndarray, *, bits: int, dim: int, rate: float, batch: int, seed: int):
        used, ids = np.unique(np.concatenate([bags.pairs, bags.grams]), return_inverse=True)  # the spare bucket is the last
        self.used, self.bits = used, bits
        bags = replace(bags, pairs=ids[: len(bags.pairs)], grams=ids[len(bags.pairs) :])
        self.bags, self.label, self.dim, self.rate, self.batch = bags, label, dim, rate, batch
        self.rng = np.random.default_rng(seed)
        self.table = self.rng.uniform(-0.5, 0.5, (len(used), dim)).astype(np.float32) / dim
        self.place, self.bucket_place = np.zeros(len(bags.gram_starts) - 1, dtype=np.int64), np.zeros(len(used), dtype=np.int64)
        self.table[-1] = 0
        self.soft, self.bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
        self.cells, self.acc_soft = np.full(len(self.table), 1e-3, dtype=np.float32), np.full((dim, 2), 1e-3, dtype=np.float32)
        key = _mixed(bags.flat.astype(np.uint64), bags.pairs.astype(np.uint64))
        _, kind = np.unique(np.add.reduceat(key, bags.starts), return_inverse=True)  # equal passages
        times, bad = np.bincount(kind), np.bincount(kind, weights=label[bags.doc] > 0.5)
        self.positive_doc = (label[bags.doc] > 0.5) & ~((times >= 3) & (bad < 0.5 * times))[kind]  # those mostly in sound documents aren't to blame
        self.target, self.keep = self.positive_doc.astype(np.int64), np.ones(len(bags.doc), dtype=bool)
        gram_sizes = bags.gram_sizes.copy()
        gram_sizes[0] = 0
        self.sizes = np.add.reduceat(gram_sizes[bags.flat] + 1, bags.starts)

    def forward(self, rows: np.ndarray) -> tuple:
        b = self.bags
        n = b.lengths[rows]
        at = _spans(b.starts[rows], n)
        words = b.flat[at]
        used = np.flatnonzero(np.bincount(words, minlength=len(self.place)))
        self.place[used] = np.arange(len(used))
        inverse = self.place[words]
        grams, pairs = b.grams[_spans(b.gram_starts[used], b.gram_sizes[used])], b.pairs[at]
        of_words = np.add.reduceat(self.table[grams], np.cumsum(b.gram_sizes[used]) - b.gram_sizes[used], axis=0)
        hidden = np.add.reduceat(of_words[inverse] + self.table[pairs], np.cumsum(n) - n, axis=0) / self.sizes[rows][:, None]
        z = hidden @ self.soft + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return n, used, inverse, grams, pairs, hidden, p / p.sum(1, keepdims=True)

    def step(self, rows: np.ndarray) -> None:
        n, used, inverse, grams, pairs, hidden, p = self.forward(rows)
        g = p.copy()
        g[np.arange(len(rows)), self.target[rows]] -= 1
        g /= len(rows)
        per_place = np.repeat((g @ self.soft.T) / self.sizes[rows][:, None], n, axis=0)
        sums = lambda where, values, k: np.stack([np.bincount(where, weights=values[:, c], minlength=k) for c in range(self.dim)], axis=1)
        per_gram = np.repeat(sums(inverse, per_place, len(used)), self.bags.gram_sizes[used], axis=0)
        ids = np.concatenate([grams, pairs])
        uniq = np.flatnonzero(np.bincount(ids, minlength=len(self.table)))
        self.bucket_place[uniq] = np.arange(len(uniq))
        grad = sums(self.bucket_place[ids], np.concatenate([per_gram, per_place]), len(uniq)).astype(np.float32)
        grad[uniq == len(self.table) - 1] = 0
        d_soft = hidden.T @ g
        self.acc_soft += d_soft**2
        self.soft -= self.rate * d_soft / np.sqrt(self.acc_soft)
        self.bias -= self.rate * 0.1 * g.sum(0)
        self.cells[uniq] += (grad**2).mean(1)
        self.table[uniq] -= self.rate * grad / np.sqrt(self.cells[uniq])[:, None]

    def round(self, seen: np.ndarray, steps: int) -> None:
        """So many batches, as 4 to 20 passes over the positive passages with negative ones drawn anew."""
        used = self.keep & seen
        pos, neg = np.flatnonzero(used & (self.target == 1)), np.flatnonzero(used & (self.target == 0))
        share = min(len(neg), max(3 * len(pos), steps * self.batch // 4 - len(pos)))
        for _ in range(int(np.clip(-(-steps * self.batch // (len(pos) + share)), 4, 20))):
            order = self.rng.permutation(np.concatenate([pos, self.rng.choice(neg, share, replace=False)]))
            for k in range(0, len(order), self.batch):
                self.step(order[k : k + self.batch])

    def judge(self, least: float) -> None:
        """Of the documents reviewed as abusive only passages that look it stay positive, at least the
        highest; a document that the model flatly contradicts is left out."""
        p = self.probability()
        top = np.zeros(len(self.label))
        np.maximum.at(top, self.bags.doc, p)
        highest = p >= top[self.bags.doc] - 1e-9
        self.target = (self.positive_doc & ((p > 0.5) | (highest & (p > least)))).astype(np.int64)
        self.keep = np.where(self.positive_doc, top[self.bags.doc] > least, p < 0.9)

    def logit(self) -> np.ndarray:
        """Of each passage."""
        rows = np.arange(len(self.bags.doc))
        p = np.concatenate([self.forward(rows[k : k + 4096])[-1] for k in range(0, len(rows), 4096)]).astype(np.float64)
        return np.log(np.maximum(p[:, 1], 1e-12) / np.maximum(p[:, 0], 1e-12))

    def probability(self) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit()))

    def documents(self) -> np.ndarray:
        """The score of each document."""
        top = np.zeros(len(self.label))
        np.maximum.at(top, self.bags.doc, self.probability())
        return top

    def weights(self) -> tuple[np.ndarray, float]:
        """The weight of each bucket, and the bias."""
        out = np.zeros((1 << self.bits) + 1, dtype=np.float32)
        out[self.used] = self.table @ (self.soft[:, 1] - self.soft[:, 0])
        return out[:-1], float(self.bias[1] - self.bias[0])


def fit_texts(texts: list[str], label: np.ndarray, held: np.ndarray, *, bits: int = 18, dim: int = 6, rounds: int = 3, steps: int = 1200, rate: float = 0.5, batch: int = 512, seed: int = 3) -> Model | None:
    """A model from texts and the share of their reviews that find them abusive. It is trained without the
    held-out texts, its cutoff is picked on these, and a last round takes all of them."""
    bags = bags_of(texts, bits)
    if not len(bags.doc) or (label > 0.5).sum() < 2 or (label < 0.5).sum() < 2:
        return None
    own = Trainer(bags, label, bits=bits, dim=dim, rate=rate, batch=batch, seed=seed)
    every = np.ones(len(bags.doc), dtype=bool)
    cutoff, agreement = 0.5, float("nan")
    checked = (label[held] > 0.5).sum() >= 5 and (label[~held] > 0.5).sum() >= 2
    seen = ~held[bags.doc] if checked else every
    for r in range(rounds):
        if r:
            own.judge((0.3, 0.5)[min(r - 1, 1)])
        own.round(seen, steps)
    if checked:
        score, truth = own.documents()[held], label[held] > 0.5
        cuts = np.linspace(0.1, 0.95, 18)
        f1 = np.array([2 * (truth & (score > c)).sum() / max(truth.sum() + (score > c).sum(), 1) for c in cuts])
        best = cuts[f1 >= f1.max() - 0.002]
        cutoff, agreement = float(best[len(best) // 2]), float(f1.max())
        own.judge(0.5)
        own.round(every, steps)
    weights, bias = own.weights()
    return Model(weights, bias, cutoff, bits, agreement)


def fit(documents: DataFrame, reviews: DataFrame, *, max_documents: int = 20_000, **options: float) -> Model | None:
    """A model from reviewed documents. documents: doc_id, text; reviews: doc_id, abusive (0, 1 or null).
    None where the reviews don't show both kinds."""
    shares = reviews.where(F.col("abusive").isin(0, 1)).groupBy("doc_id").agg(F.avg("abusive").alias("share"))
    rows = (
        documents.where("text is not null").select("doc_id", "text").join(shares, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents).select("doc_id", "text", "share")
    ).collect()
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows], dtype=bool)
    return fit_texts([r.text for r in rows], np.array([r.share for r in rows]), held, **options)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(model.bits, model.weights.astype(np.float64))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # bounds the arrays of a batch
                batch = whole.slice(at, 500)
                parts, owner = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        new = passages(t)
                        parts += new
                        owner += [k] * len(new)
                scores = np.zeros(batch.num_rows)
                if parts:
                    top = np.full(batch.num_rows, -np.inf)
                    np.maximum.at(top, owner, own.logits(parts, model.bias))
                    scores = 1 / (1 + np.exp(-top))
                yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scores(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and is_abusive of every document."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_abusive"))
    return map_arrow(rows, _scorer(model), "doc_id long, score double").withColumn("is_abusive", F.col("score") > model.cutoff)


def rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """For each source, its name trimmed and in lower case: documents, abusive ones, their share, and the
    mean score. documents: doc_id (unique), source."""
    return (
        documents.select("doc_id", source_name("source").alias("source")).join(scored, "doc_id").groupBy("source")
        .agg(F.count("*").alias("n_documents"), F.count(F.when(F.col("is_abusive"), 1)).alias("n_abusive"), F.avg(F.col("is_abusive").cast("double")).alias("abusive_rate"), F.avg("score").alias("mean_score"))
    )
