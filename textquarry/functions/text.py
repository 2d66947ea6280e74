"""Text scalars: Column in, Column out, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of a token, of a word and of the answer marker.
TOKEN = r"[a-zA-Z]+(?:'[a-zA-Z]+)*|\d|\n|\S"
WORD = r"[a-zA-Z]+(?:'[a-zA-Z]+)*"
MARKER = r"[Ss]o my answer is:"

# Typographic characters and their plain forms.
PLAIN_FROM, PLAIN_TO = "\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201c\u201d\u00a0", "------''\"\" "


# All characters that count as white space at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """A text without white space of any kind at its ends (a plain trim takes off blanks alone)."""
    return F.btrim(_c(x), F.lit(BLANKS))


def lstrip(x: str | Column) -> Column:
    return F.ltrim(_c(x), F.lit(BLANKS))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named: inside the lambdas of folds
    and searches an expression would else be worked out anew at every step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: str | Column) -> Column:
    """Words with inner apostrophes, single digits, newlines and single other signs."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def words(text: str | Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def split_words(text: str | Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    """The number of pieces between white space; 0 for null."""
    return F.coalesce(F.size(split_words(text)), F.lit(0))


def response_words(text: str | Column) -> Column:
    """Words of a response; 0 for an empty one or one that begins with `<`."""
    t = _c(text)
    return F.when(t.isNull() | (t == "") | t.startswith("<"), 0).otherwise(word_count(t))


def usable(text: str | Column, stripped: bool = True) -> Column:
    """Whether there is a text and it is no <...> error; without `stripped` leading blanks hide the sign."""
    t = _c(text)
    body = lstrip(t) if stripped else t
    return F.coalesce((t != "") & ~body.startswith("<"), F.lit(False))


def plain_signs(text: str | Column) -> Column:
    """Typographic hyphens, dashes, quotes, ellipsis and blanks in their plain forms."""
    return F.replace(F.translate(_c(text), PLAIN_FROM, PLAIN_TO), F.lit("…"), F.lit("..."))


def violations(text: str | Column, vocabulary: Sequence[str]) -> Column:
    """The tokens outside a small vocabulary given as literals, in order, repeats kept. For larger ones
    use operators.vocabulary.violations."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    return F.filter(tokens(text), lambda t: ~F.array_contains(known, F.lower(t)) & ~F.array_contains(known, t))


def is_capital(word: Column) -> Column:
    return F.substring(word, 1, 1).rlike(r"\p{Lu}")


def split_violations(found: str | Column, allowed: Sequence[str] = ()) -> dict[str, Column]:
    """Violations as allowed proper nouns, other proper nouns and lexical ones."""
    names = F.array(*[F.lit(a) for a in allowed]) if allowed else F.expr("cast(array() as array<string>)")
    v = _c(found)
    return {
        "proper_allowed": F.filter(v, lambda w: is_capital(w) & F.array_contains(names, F.lower(w))),
        "proper_other": F.filter(v, lambda w: is_capital(w) & ~F.array_contains(names, F.lower(w))),
        "lexical": F.filter(v, lambda w: ~is_capital(w)),
    }


def correction_list(found: str | Column, most: int = 20) -> Column:
    """The first violations in quotes, and how many more there are."""
    v = _c(found)
    head = F.array_join(F.transform(F.slice(v, 1, most), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", ")
    return F.when(F.size(v) > most, F.concat(head, F.lit(" (and "), (F.size(v) - most).cast("string"), F.lit(" more)"))).otherwise(head)


def strip_markdown(text: str | Column) -> Column:
    """Headers, bold, italics, code marks and links taken off, their text kept."""
    out = _c(text)
    for pattern, to in ((r"#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
        out = F.regexp_replace(out, pattern, to)
    return out


def is_artifact(paragraph: str | Column) -> Column:
    """A paragraph of markup alone: an image or link, a rule, an empty header."""
    return _c(paragraph).rlike(r"^(!?\[|---+|===+|\*\*\*+|#{1,6}\s*$)")


def tidy(text: str | Column) -> Column:
    """Italic underscores off, white space collapsed and trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(_c(text), r"_([^_]+)_", "$1"), r"\s+", " "))


# The verbs of an attribution.
SPEECH_VERBS = "said|replied|cried|continued|answered|returned|added|resumed|interrupted|exclaimed|observed|rejoined"


def speaker_line(names: Sequence[str]) -> str:
    """The pattern of a line that a speaker of a cast opens."""
    return r"^\s*(" + "|".join(names) + r")[.:]\s*"


def attribution(text: str | Column, names: Sequence[str]) -> Column:
    """The speaker named by a verb of speech, in upper case; null without one."""
    hit = F.regexp_extract(_c(text), rf"(?i)[,;]?\s+(?:{SPEECH_VERBS})\s+({'|'.join(names)})\b", 1)
    return F.nullif(F.upper(hit), F.lit(""))


def without_attribution(text: str | Column, names: Sequence[str]) -> Column:
    """The speech alone: attribution off, outer marks off, closed by a full stop where none closes it."""
    out = F.regexp_replace(_c(text), rf"(?i),?\s+(?:{SPEECH_VERBS})\s+(?:{'|'.join(names)})\b,?", "")
    out = F.btrim(F.regexp_replace(strip(out), r"\s+", " "), F.lit(" ,;."))
    return F.when((out == "") | out.rlike(r"[.?!]$"), out).otherwise(F.concat(out, F.lit(".")))


def without_margin_numbers(text: str | Column) -> Column:
    """Section numbers of up to three digits at the ends of lines taken off."""
    return F.regexp_replace(_c(text), r"(?m)[ \t]+\d{1,3}[ \t]*$", "")


def from_header(text: str | Column, header: str) -> Column:
    """What follows the line of a header; null without it."""
    body = F.regexp_extract(_c(text), rf"(?ms)^{header}\s*$(.*)\z", 1)
    return F.when(_c(text).rlike(rf"(?m)^{header}\s*$"), body)


def passage_after(text: str | Column, label: str = "Extended passage") -> Column:
    """What follows the label's own line; the trimmed text without one."""
    parts = F.split(_c(text), rf"(?i)\n\s*{label}:\s*\n", 2)
    return strip(F.element_at(parts, -1))


def marker_count(text: str | Column) -> Column:
    return F.size(F.regexp_extract_all(_c(text), F.lit(MARKER), F.lit(0)))


def answer_parts(text: str | Column) -> dict[str, Column]:
    """The reasoning before and the answer after the last marker, with the state of the format."""
    t, n = _c(text), marker_count(text)
    whole = rf"(?s)^(.*){MARKER}(.*)$"
    has = n > 0
    reasoning = F.when(has, F.regexp_replace(F.regexp_extract(t, whole, 1), r"\s+$", ""))
    answer = F.when(has, F.nullif(F.regexp_replace(F.regexp_extract(t, whole, 2), r"^\s+|\s+$", ""), F.lit("")))
    mode = F.when(n == 0, "no_marker").when(n > 1, "multiple_markers").when(answer.isNull(), "empty_answer")
    return {"n_markers": n, "reasoning": reasoning, "answer": answer, "failure_mode": mode, "parse_ok": t.isNotNull() & mode.isNull()}


def final_answer(text: str | Column, cue: str = "final answer") -> dict[str, Column]:
    """Reasoning and answer at the last cue; without one (or with nothing on either side) the last
    sentence is the answer; a single sentence is both."""
    t = strip(_c(text))
    pattern = rf"(?is)^(.*){cue}\s*:\s*(.*)$"
    before, after = strip(F.regexp_extract(t, pattern, 1)), strip(F.regexp_extract(t, pattern, 2))
    parts = F.split(t, r"(?<=[.!?])\s+")
    cued, several = (before != "") & (after != ""), F.size(parts) >= 2
    return {
        "reasoning": F.when(cued, before).when(several, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")).otherwise(t),
        "answer": F.when(cued, after).when(several, F.element_at(parts, -1)).otherwise(t),
    }


def has_loop(text: str | Column, n: int = 4, times: int = 3) -> Column:
    """Whether n words come `times` times in a row: a stretch equals itself n words further on."""
    span = n * (times - 1)

    def found(k: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(k) - n * times, F.lit(0)))
        return F.when(F.size(k) >= n * times, F.exists(at, lambda p: F.slice(k, p + 1, span) == F.slice(k, p + 1 + n, span))).otherwise(False)

    return F.coalesce(bound(split_words(text), found), F.lit(False))


def verdict(text: str | Column) -> Column:
    """follows or does not follow, from a model's wording; null where neither is said."""
    t = F.lower(strip(_c(text)))
    return F.when(t.contains("does not follow") | t.contains("not follow"), "does not follow").when(t.contains("follow"), "follows")


def validity(text: str | Column, tail: int = 400) -> Column:
    """valid or invalid, whichever is said last as a whole word near the end."""
    last = F.regexp_extract(F.right(F.lower(_c(text)), F.lit(tail)), r"(?s)^.*\b(invalid|valid)\b", 1)
    return F.nullif(last, F.lit(""))


def braces(text: str | Column) -> Column:
    """From the first { to the last }, code fences off; null without both."""
    bare = F.regexp_replace(strip(_c(text)), r"(?m)^```\w*\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def judged(text: str | Column, dims: Sequence[str], low: int = 0, high: int = 4) -> Column:
    """The scores of a judge's reply as a struct of whole numbers; null unless every dimension is there,
    is a number and lies in range once cut to a whole number."""
    schema = "struct<" + ", ".join(f"{d}:struct<score:double, justification:string>" for d in dims) + ">"
    obj = F.from_json(braces(text), schema, {"mode": "PERMISSIVE"})
    scores = [obj[d]["score"].cast("int") for d in dims]
    ok = F.lit(True)
    for s in scores:
        ok = ok & F.coalesce(s.between(low, high), F.lit(False))
    return F.when(ok, F.struct(*[s.alias(d) for s, d in zip(scores, dims, strict=True)]))


def safe_int(x: str | Column) -> Column:
    """A whole number, or null where the value is none."""
    return _c(x).try_cast("int")


def first_score(text: str | Column) -> Column:
    """The first digit from 0 to 4 in a reply, -1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(text), "[0-4]", 0), F.lit("")).cast("double"), F.lit(-1.0))


def original_id(item: str | Column) -> Column:
    """The id of the record that a held-out item was made of; null for items of other kinds."""
    t = _c(item)
    body = F.regexp_extract(t, r"^cxbot-(?:defcx|abdcx)-(.*?)(?:-reasoning|-passage)?$", 1)
    return F.when(t.rlike(r"^cxbot-(?:defcx|abdcx)-"), F.translate(body, "-", "_"))


def capitalised(text: str | Column) -> Column:
    """The first letter in upper case and all others in lower case."""
    t = _c(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2**31 - 1)))


def escaped(text: str | Column) -> Column:
    """Ready for HTML, line ends as breaks."""
    out = F.coalesce(_c(text), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def query_text(instruction: str | Column, question: str | Column, always: bool = False) -> Column:
    """Instruction, blank line, question; with `always` also where the instruction is empty."""
    i, q = F.coalesce(_c(instruction), F.lit("")), F.coalesce(_c(question), F.lit(""))
    both = F.concat(i, F.lit("\n\n"), q)
    return both if always else F.when(strip(i) != "", both).otherwise(q)
