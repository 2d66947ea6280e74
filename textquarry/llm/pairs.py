"""Broken prompt and response pairs.

Method: for every defect several noisy labelling functions vote +1 (defective), -1 (sound) or 0 (abstain)
on each pair. Each looks at one sign alone, knows nothing of the others, and errs: a short answer has few
words like an empty one, a quotation repeats the prompt like an echo, "I do not think" denies like a
refusal. A label model with one hidden class per defect (a table of the three votes for each function and
class) is fitted by expectation maximization on the counts of the vote patterns of all rows, so the
functions' accuracies are learnt from where they agree; its posteriors above the cutoff of a defect become
labels. A pattern has a handful of votes, so the table of patterns is bounded (3^votes), whatever the rows.

Some functions rest on the corpus: the words that are common in answers to prompts of one language, the
letters that are rare there, and the sentences that close answers to different prompts. They are counted
over all rows and kept where they reach a share of the rows, which bounds their number.

The cutoffs are picked on planted defects of held-out rows (choose_cutoffs, tests/llm/test_pairs.py).

Languages: the prompt's language is told by function words of seven languages or by its script; a response
is foreign by its script, by function words of another language, by letters that answers to such prompts
rarely hold, or because few of its words are common in these answers, which needs no list. Not told apart
are two unlisted languages of one script asked and answered, and responses of under four words in the
prompt's script.

Defined results: a null or blank response is `empty`; a null prompt leaves echo and language without votes;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import truncation
from textquarry.session import map_arrow, materialise

MARKER = re.compile(r"[Ss][Oo] [Mm][Yy] [Aa][Nn][Ss][Ww][Ee][Rr] [Ii][Ss]\s*:")
WORD = re.compile(r"[^\W_]+")
LETTER = re.compile(r"[^\W\d_]")
BEYOND_LATIN = re.compile(r"[^\W\d_\x00-\u024f]")
QUOTED = re.compile(r"“[^”]*”|\"[^\"]*\"|«[^»]*»|‘[^’]{12,}’")
SENTENCE = re.compile(r"[^.!?\n]+")
BRACKETED = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\([^()]*\)")
TRIM = "\u200b\ufeff\u2060 \t\r\n\xa0"
CLOSERS = TRIM + "\"'`.,;:!?-–—_*#|/\\()[]{}<>”’»"
TRIM_SIGNS = TRIM + "\"'`.,;:!?-–—_*#|/\\"

# What stands for no content.
PLACEHOLDER = re.compile(r"n\s*/?\s*a|null|none|nil|nan|undefined|todo|tbd|empty|blank|no (?:output|response|answer|content|text|reply)|(?:\w+_)?error\b.*|timed? ?out|missing|unknown|end of answer", re.I)
# Signs of declining, each of its own kind.
DENY = re.compile(r"\bi\b(?:'\w+)?[^.!?\n]{0,14}?(?:\bnot\b|n't\b|\bcannot\b|\bunable\b|\brefuse|\bdecline|\brather\b|\bprefer|\bpass\b|\bleave\b|\bsilent|\bstay away)|\bagainst my\b|\boutside what i\b|\bnot a thing i\b")
ASKED_OF = re.compile(r"\b(?:ask|answer|help|assist|reply|respond|discuss|comment|talk|speak|say|questions?|request|topic|matter|do (?:that|this)|this one|that one|advice|provide)\b")
COURTESY = re.compile(r"\b(?:sorry|afraid|unfortunately|regrettably|apolog\w*|i regret|with respect|thank you|please|hope you)\b|^no\.")
ROLE = re.compile(r"\blanguage model\b|\ban ai\b|\bassistant\b|\bmy (?:rules|guidelines|policy|policies|makers|training)\b|\b(?:am|m|are) (?:not )?(?:allowed|permitted|comfortable|able|supposed)\b|\bbeen (?:told|asked|instructed|trained)\b|\bi may (?:not )?(?:talk|speak|say)\b|\bfeel comfortable\b")
ELSEWHERE = re.compile(r"\b(?:someone|somebody|something|anything) else\b|\bother things\b|\banother (?:thing|question|topic)\b|\btrained person\b|\bbetter guide\b|\byou should\b|\blet us talk\b")

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and of to in that is are was it for on with as by this be not or from at which one each some who what has have does if we say should would can then they no but only when there so yes because between such",
    "fr": "le la les des une et que qui dans est pas pour sur avec ce cette il elle nous vous je ne si mais comment pourquoi sans même depuis quand alors aussi plus du au peut dire personne suffit l d",
    "de": "der die das und ist nicht ein eine zu mit von auf für dass sich wir ich es den dem im wenn dann auch warum wie nach vor ohne man in ob weil kann dürfen an so um",
    "es": "el la los las una y que es no se por para con del al en como si pero porque cuando entonces también sin antes creo nadie sabe esta este más incluso desde nos",
    "pt": "o a os as um uma e que não se por para com do da dos das no na em como mas porque quando então também sem antes acho ninguém sabe esta este mais mesmo desde nos pode ao há",
    "it": "il lo la i gli le un una e che non si per con del della dei in nel come ma perché quando allora anche senza prima penso nessuno sa questa questo più da ci può sia tra alla",
    "nl": "de het een en van is niet dat die in op met voor zijn we ik als dan ook waarom hoe naar zonder men om maar dit er aan bij wordt kan moet geen",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _k, _v in _FUNCTION.items():
    for _w in _v:
        _LANGUAGES[_w] = (*_LANGUAGES.get(_w, ()), _k)

#: The labelling functions of each defect.
VOTES = {
    "empty": ("no_sign", "no_known_word", "bracketed", "placeholder", "brief", "after_marker", "hint"),
    "truncated": ("no_stop", "prefix", "sentence", "mark", "recurs", "brief"),
    "refusal": ("deny", "asked_of", "courtesy", "role", "elsewhere", "brief", "recurs"),
    "echo": ("runs", "new_words", "cover", "length", "start"),
    "language": ("function_words", "unfamiliar", "letters", "halves", "script"),
}
#: Where the model starts: how often a function votes +1 on a defective row and on a sound one; BELIEF for all others.
BELIEF = (0.8, 0.05)
BELIEFS = {
    "empty_no_sign": (0.5, 0.01), "empty_no_known_word": (0.9, 0.3), "empty_bracketed": (0.5, 0.005), "empty_placeholder": (0.4, 0.005), "empty_brief": (0.9, 0.3), "empty_after_marker": (0.8, 0.01),
    "truncated_no_stop": (0.95, 0.3), "truncated_mark": (0.1, 0.005), "truncated_prefix": (0.4, 0.01), "truncated_recurs": (0.97, 0.5),
    "refusal_deny": (0.8, 0.1), "refusal_courtesy": (0.6, 0.03), "refusal_role": (0.4, 0.03), "refusal_elsewhere": (0.4, 0.03), "refusal_recurs": (0.7, 0.1), "refusal_brief": (0.7, 0.2),
    "echo_cover": (0.9, 0.15), "echo_length": (0.6, 0.2), "echo_start": (0.7, 0.2), "language_script": (0.3, 0.002), "language_letters": (0.6, 0.02),
}
OWN = ("empty", "refusal", "echo", "language")
#: Posteriors above which a label is kept, in the order in which labels of a row are preferred.
CUTOFFS = {"empty": 0.5, "echo": 0.5, "refusal": 0.5, "language": 0.5, "truncated": 0.5}


def _most(score: Counter, n_words: int) -> str | None:
    (best, most), second = (score.most_common(2) + [(None, 0)] * 2)[:2]
    return best if most >= max(2, 0.12 * n_words) and most > second[1] else None


def language_of(words: list[str], least: int = 4) -> str | None:
    """The language whose function words cover most of the words; None where too few are known."""
    return _most(Counter(k for w in words for k in _LANGUAGES.get(w, ())), len(words)) if len(words) >= least else None


@lru_cache(100_000)
def _script(sign: str) -> str:
    script = unicodedata.name(sign, "").split(" ")[0]
    return "CJK" if script in ("HIRAGANA", "KATAKANA") else script


def script_of(text: str) -> str | None:
    """The script of most letters; None where there are fewer than four (two where a letter is a syllable)."""
    if not BEYOND_LATIN.search(text):
        return "LATIN" if len(list(islice(LETTER.finditer(text), 4))) == 4 else None
    n = Counter(_script(c) for c in text if c.isalpha())
    script, most = max(n.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
    return script if most >= (2 if script in ("CJK", "HANGUL") else 4) and 2 * most > n.total() else None


@dataclass
class Corpus:
    """What was learnt from all rows. common, known: for each language of prompts the words of a share of
    the answers; letters: the letters beyond ASCII that aren't rare there; closes: the hashes of sentences
    that close answers to different prompts."""

    common: dict[str, frozenset] = field(default_factory=dict)
    known: frozenset = frozenset()
    letters: dict[str, frozenset] = field(default_factory=dict)
    closes: frozenset = frozenset()


class Prompt:
    """What is used of a prompt; prompts repeat, so these are kept per worker."""

    def __init__(self, text: str):
        self.words = [w.lower() for w in WORD.findall(text)]
        self.bag = set(self.words)
        self.runs = set(zip(self.words, self.words[1:], self.words[2:], strict=False))
        self.script = script_of(text)
        self.language = language_of(self.words) or (self.script if self.script not in (None, "LATIN") else "?")


def _last_sentence(low: str) -> str:
    """The last sentence with words, without marks."""
    body = low.rstrip(CLOSERS)
    if body.endswith("end of answer"):
        body = body[:-13].rstrip(CLOSERS)
    cut = max(body.rfind(c) for c in ".!?\n:")
    return " ".join(body[cut + 1 :].split())


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


SURVEY = "kind string, language string, item string, key long, prompt long, n long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over a partition: rows with each word or letter, by the language of the prompt, and the
    prompts of each closing sentence."""
    prompts, counts = lru_cache(20_000)(Prompt), Counter()

    def flush() -> pa.RecordBatch:
        keys, n = list(zip(*counts.keys(), strict=True)), list(counts.values())
        counts.clear()
        return pa.record_batch([*(pa.array(c, t) for c, t in zip(keys, (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)), pa.array(n, pa.int64())], names=["kind", "language", "item", "key", "prompt", "n"])

    for batch in batches:
        for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not t:
                continue
            low = t.lower()
            language, words = prompts(p or "").language, WORD.findall(low)
            counts["close", None, None, _hash(_last_sentence(low)), _hash(p or "")] += 1
            if len(words) >= 4:
                counts["rows", language, None, None, None] += 1
                for w in set(words):
                    counts["word", language, w, None, None] += 1
                if not low.isascii():
                    for c in {c for c in low if c > "\x7f" and c.isalpha()}:
                        counts["letter", language, c, None, None] += 1
        if len(counts) > 500_000:
            yield flush()
    if counts:
        yield flush()


def learnt(pairs: DataFrame, *, common: float = 0.05, known: float = 0.005, rare: float = 0.05, closes: float = 1e-4) -> Corpus:
    """What the labelling functions take from the corpus. common, known: the shares of the answers (of at
    least four words) to prompts of one language that hold a word; rare: likewise of a letter; closes: the
    share of all rows that a sentence closes. Each share bounds what is collected: at most words of a row
    / known, and 1 / closes sentences."""
    counted = materialise(map_arrow(pairs, _survey, SURVEY).groupBy("kind", "language", "item", "key", "prompt").agg(F.sum("n").alias("n")), "survey")
    rows = {r.language: r.n for r in counted.where("kind = 'rows'").select("language", "n").collect()}  # one row per language
    total = counted.where("kind = 'close'").agg(F.sum("n")).first()[0] or 0
    out = Corpus()
    if rows:
        of = F.create_map(*(F.lit(x) for kv in rows.items() for x in kv))
        shares = counted.where("kind in ('word', 'letter')").withColumn("share", F.col("n") / of[F.col("language")])
        out.known = frozenset(r.item for r in shares.where(f"kind = 'word' and share >= {known}").select("item").distinct().collect())
        big = {k for k, n in rows.items() if n >= 30}  # of fewer answers nothing is learnt
        for name, where in (("common", f"kind = 'word' and share >= {common}"), ("letters", f"kind = 'letter' and share >= {rare}")):
            held: dict[str, set] = {k: set() for k in big}
            for r in shares.where(where).select("language", "item").collect():
                held.get(r.language, set()).add(r.item)
            setattr(out, name, {k: frozenset(v) for k, v in held.items()})
    closing = counted.where("kind = 'close'").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("prompts"))
    out.closes = frozenset(r.key for r in closing.where(f"prompts >= 3 and n >= {max(3.0, closes * total)}").select("key").collect())
    return out


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def _empty_votes(text: str, hint: str | None, known: frozenset, function: frozenset) -> list[int]:
    """Votes on what follows the last answer marker, or on the whole without one."""
    mark = None
    for mark in MARKER.finditer(text):
        pass
    body = text[mark.end() :] if mark else text
    if mark or len(body) < 200:
        body = re.sub(r"(?i)end of answer\.?\s*$", "", body).strip(TRIM)
    words = WORD.findall(body) if len(body) < 200 else ["", ""] * 5
    if len(words) >= 10:
        return [-1, -1, -1, -1, -1, -1 if mark else 0, int(hint == "empty_answer")]
    bare = body.strip(TRIM_SIGNS)
    return [
        _vote(not words, True), _vote(not any(w.isdigit() or (len(w) > 1 and (w.lower() in known or w.lower() in function)) for w in words), True), _vote(not words or bool(BRACKETED.fullmatch(body)), True),
        _vote(bool(PLACEHOLDER.fullmatch(bare.strip("<>[](){}"))), True), _vote(len(words) <= 4, len(words) >= 8), _vote(mark and not words, mark), int(hint == "empty_answer"),
    ]


def _refusal_votes(low: str, n_words: int, close: int) -> list[int]:
    plain = low.replace("’", "'").lstrip()
    if re.search(r"[“\"«‘]", plain):
        plain = QUOTED.sub(" ", plain)
    brief = _vote(n_words <= 25, n_words > 60)
    signs = [bool(x.search(plain)) for x in (DENY, COURTESY, ROLE, ELSEWHERE)]
    if not any(signs):
        return [-1, -1, -1, -1, -1, brief, close]
    asked = False
    for m in SENTENCE.finditer(plain):
        s = m.group(0)
        if any(x.search(s) for x in (DENY, ROLE, ELSEWHERE)):
            asked = asked or bool(ASKED_OF.search(MARKER.sub(" ", s)))
    return [_vote(signs[0], True), _vote(asked, True), *(_vote(x, True) for x in signs[1:]), brief, close]


def _echo_votes(p: Prompt, words: list[str]) -> list[int]:
    if len(words) < 5:
        return [-1, -1, -1, -1, -1]
    if len(p.words) < 5:
        return [0, 0, 0, 0, 0]
    new = sum(w not in p.bag for w in words) / len(words)
    bag = set(words)
    cover = sum(w in bag for w in p.words) / len(p.words)
    ratio = len(words) / len(p.words)
    start = _vote(" ".join(p.words[:3]) in " ".join(words[:8]), True)
    if new > 0.9:
        runs = 0.0
    else:
        runs = sum(x in p.runs for x in zip(words, words[1:], words[2:], strict=False)) / (len(words) - 2)
    return [_vote(runs >= 0.45, runs < 0.4), _vote(new <= 0.4, new >= 0.45), _vote(cover >= 0.5, cover < 0.3), _vote(0.6 <= ratio <= 1.6, ratio > 3), start]


def _language_votes(p: Prompt, text: str, words: list[str], corpus: Corpus) -> list[int]:
    written = script_of(MARKER.sub(" ", text))
    other = _vote(bool(p.script and written) and written != p.script, bool(p.script and written))
    if not p.words:
        return [0, 0, 0, 0, 0]
    if len(words) < 4:
        return [0, 0, 0, 0, other]
    get, half = _LANGUAGES.get, len(words) // 2
    parts = [Counter(k for ks in map(get, part) if ks for k in ks) for part in (words[:half], words[half:])]
    score = parts[0] + parts[1]
    own, most = score.pop(p.language, 0), max(score.values(), default=0)
    function = _vote(most >= 2 and most > own, own >= 0.15 * len(words) and own > most) if p.language in _FUNCTION else 0
    common, strange = corpus.common.get(p.language), -1 if text.isascii() else 0
    unfamiliar = 0
    if common:
        share = sum(w in common for w in words) / len(words)
        unfamiliar = _vote(share < 0.15, share >= 0.25)
    if not text.isascii() and p.language in corpus.letters:
        usual = corpus.letters[p.language]
        strange = _vote(sum(any(c > "\x7f" and c not in usual for c in w) for w in words) >= 2, True)
    halves = [_most(parts[0], half), _most(parts[1], len(words) - half)]
    foreign, same = (sum(x is not None and (x != p.language) == y for x in halves) for y in (True, False))
    return [function, unfamiliar, strange, _vote(foreign > same, same > foreign) if p.language in _FUNCTION else 0, other]


def _voter(corpus: Corpus):
    names = [f"{d}_{v}" for d in OWN for v in VOTES[d]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prompts = lru_cache(20_000)(Prompt)

        @lru_cache(2_000)
        def row(p: str, t: str, hint: str | None) -> list[int]:
            asked, low = prompts(p), t.lower()
            words = WORD.findall(low)
            close = _vote(_hash(_last_sentence(low)) in corpus.closes, True)
            return _empty_votes(t, hint, corpus.known, _FUNCTION.get(asked.language, frozenset())) + _refusal_votes(low, len(words), close) + _echo_votes(asked, words) + _language_votes(asked, t, words, corpus)

        for batch in batches:
            ids, ps, texts, hints = (batch.column(k).to_pylist() for k in range(4))
            rows = [row(p or "", t or "", h) for p, t, h in zip(ps, texts, hints, strict=True)]
            votes = np.array(rows, dtype=np.int8).reshape(len(rows), len(names))
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(votes[:, k]) for k in range(len(names)))], names=["rec_id", *names])

    return run


def votes(pairs: DataFrame) -> DataFrame:
    """All votes on each pair. pairs: rec_id BIGINT, prompt, response, hint STRING."""
    names = [f"{d}_{v}" for d in OWN for v in VOTES[d]]
    cast = pairs.select(F.col("rec_id").cast("long"), *(F.col(c).cast("string") for c in ("prompt", "response", "hint")))
    own = map_arrow(cast, _voter(learnt(cast)), "rec_id long, " + ", ".join(f"{n} byte" for n in names))
    texts = cast.select(F.lit("").alias("corpus"), "rec_id", F.lit(None).cast("string").alias("source"), F.col("response").alias("text"))
    ends = truncation.judged(texts).select(
        "rec_id",
        F.when(F.col("kind").isin("bare", "open", "broken"), 1).otherwise(0).alias("no_stop"),
        F.when(F.col("n").isNull() & (F.col("words_below") > 0), 1).when(F.col("n").isNotNull(), -1).otherwise(0).alias("prefix"),
        F.when(F.col("p") < 0.05, 1).when(F.col("p") >= 0.5, -1).otherwise(0).alias("sentence"),
        F.when(F.col("kind").isin("broken", "open"), 1).otherwise(-1).alias("mark"),
        F.when(F.col("evidence").isin("answer", "ending", "list"), -1).otherwise(1).alias("recurs"),
        F.when(F.col("n_words") <= 4, -1).otherwise(0).alias("brief"),
    ).dropDuplicates(["rec_id"])
    joined = own.join(ends, "rec_id", "left")
    return joined.select("rec_id", *names, *(F.coalesce(F.col(v), F.lit(-1 if v in ("no_stop", "mark") else 0)).cast("byte").alias(f"truncated_{v}") for v in VOTES["truncated"]))


def fit(patterns: np.ndarray, counts: np.ndarray, *, beliefs: list[tuple[float, float]] | None = None, rounds: int = 200, prior: float = 0.03, weight: float = 0.01) -> np.ndarray:
    """The posterior of the defect for each vote pattern, by expectation maximization.

    patterns: rows of votes in -1, 0, 1; counts: rows of the data that show each; beliefs: for each
    function, how often it votes +1 on a defective and on a sound row. A vote of 0 says nothing either
    way. The beliefs are where the tables start, and count as a share `weight` of the rows in every step,
    so the classes can't change sides."""
    n_votes = patterns.shape[1]
    plus = np.array(beliefs or [BELIEF] * n_votes)
    start = np.stack([np.stack([1 - plus[:, c], plus[:, c]], 1) for c in (1, 0)])  # class, vote, value -1 or 1
    table, pi = start.copy(), prior
    held = weight * counts.sum() * np.array([1 - prior, prior])[:, None, None] + 5.0
    said, at = patterns != 0, (patterns > 0).astype(np.int64)
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        like = np.stack([(np.log(table[c][np.arange(n_votes), at]) * said).sum(1) for c in (0, 1)])
        like += np.log([[1 - pi], [pi]])
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        for c, share in ((0, 1 - post), (1, post)):
            mass = counts * share
            seen = np.stack([np.bincount(at[:, v], weights=mass * said[:, v], minlength=2) for v in range(n_votes)])
            table[c] = (seen + held[c] * start[c]) / (seen.sum(1, keepdims=True) + held[c])
        pi = (float((counts * post).sum()) + 20 * prior) / (counts.sum() + 20)
        if done:
            break
    return post


def choose_cutoffs(scored: dict[str, np.ndarray], truth: dict[str, np.ndarray]) -> dict[str, tuple[float, float, float]]:
    """For each defect the cutoff that agrees best with known cases, its precision and its recall."""
    out = {}
    for d, score in scored.items():
        yes = truth[d]
        found = []
        for cut in np.linspace(0.05, 0.95, 19):
            hit = score > cut
            both = (hit & yes).sum()
            found.append((2 * both / max(hit.sum() + yes.sum(), 1), -abs(cut - 0.5), cut, both / max(hit.sum(), 1), both / max(yes.sum(), 1)))
        out[d] = tuple(float(x) for x in max(found)[2:])
    return out


def posteriors(pairs: DataFrame) -> DataFrame:
    """rec_id and the posterior of each defect."""
    voted = materialise(votes(pairs), "votes")
    out = voted
    for defect, names in VOTES.items():
        cols = [f"{defect}_{v}" for v in names]
        rows = voted.groupBy(*cols).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(cols) rows
        patterns = np.array([r[:-1] for r in rows], dtype=np.int64).reshape(len(rows), len(cols))
        post = fit(patterns, np.array([r[-1] for r in rows], dtype=float), beliefs=[BELIEFS.get(c, BELIEF) for c in cols]) if rows else np.empty(0)
        schema = ", ".join(f"{c} byte" for c in cols) + f", {defect} double"
        table = pairs.sparkSession.createDataFrame([(*map(int, p), float(x)) for p, x in zip(patterns, post, strict=True)], schema)
        out = out.join(F.broadcast(table), cols)
    return out.select("rec_id", *VOTES)


def labels(pairs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """One row for each pair and defect whose posterior exceeds the cutoff: rec_id, defect, posterior."""
    cut = CUTOFFS | (cutoffs or {})
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior"), F.lit(cut[d]).alias("cutoff")) for d in VOTES)))
    return posteriors(pairs).select("rec_id", each.alias("x")).select("rec_id", "x.defect", "x.posterior", "x.cutoff").where("posterior > cutoff").drop("cutoff")


def main_defect(pairs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """The defect of each defective pair; of several, the first in the order of CUTOFFS, for an empty or
    echoing response also looks cut, and a refusal or a foreign answer may be."""
    cut = CUTOFFS | (cutoffs or {})
    first = F.coalesce(*(F.when(F.col(d) > cut[d], F.lit(d)) for d in CUTOFFS))
    return posteriors(pairs).select("rec_id", first.alias("defect")).where("defect is not null")
