"""Token-id sequences: encoding, masks, budgets, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import strip, tokens

# The special tokens in the order of their ids, and the label that is not trained on.
SPECIAL = ("<PAD>", "<UNK>", "<BOS>", "<EOS>", "<CAP>")
PAD, UNK, BOS, EOS, CAP = range(5)
IGNORED = -100


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pieces(text: str | Column, vocab: Column) -> Column:
    """Vocabulary tokens of a text: a capitalised word of more than a letter is <CAP> and the word in
    lower case, an unknown one <UNK>. vocab: a map from token to id."""

    def of(t: Column) -> Column:
        low = F.lower(t)
        cap = F.substring(t, 1, 1).rlike(r"\p{Lu}") & (F.length(t) > 1)
        known = F.array_contains(F.map_keys(vocab), low)
        return F.when(known & cap, F.array(F.lit("<CAP>"), low)).when(known, F.array(low)).when(F.array_contains(F.map_keys(vocab), t), F.array(t)).otherwise(F.array(F.lit("<UNK>")))

    return F.flatten(F.transform(tokens(text), of))


def ids(piece: str | Column, vocab: Column) -> Column:
    return F.transform(_c(piece), lambda t: F.coalesce(F.element_at(vocab, t), F.lit(UNK)))


def wrapped(seq: str | Column, second: str | Column | None = None) -> Column:
    """The sequence between begin and end, and a second one likewise after it."""
    one = F.concat(F.array(F.lit(BOS)), _c(seq), F.array(F.lit(EOS)))
    return one if second is None else F.concat(one, F.array(F.lit(BOS)), _c(second), F.array(F.lit(EOS)))


def detokenised(piece: str | Column) -> Column:
    """Text again: no blank before closing marks, <CAP> raises the next word, specials left out."""
    closing = F.array(*[F.lit(x) for x in (".", ",", "!", "?", ";", ":", ")", "'", '"')])
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("cap"))

    def step(st: Column, t: Column) -> Column:
        out, cap = st["out"], st["cap"]
        first = out == ""
        glued = first | F.endswith(out, F.lit("\n")) | F.array_contains(closing, t)
        word = F.when(cap, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2**31 - 1)))).otherwise(t)
        nxt = F.when(t == "\n", F.concat(out, t)).otherwise(F.concat(out, F.when(glued, F.lit("")).otherwise(F.lit(" ")), word))
        return (
            F.when(t.isin("<BOS>", "<EOS>", "<PAD>", "<UNK>"), st)
            .when(t == "<CAP>", F.struct(out.alias("out"), F.lit(True).alias("cap")))
            .otherwise(F.struct(nxt.alias("out"), F.when(t == "\n", cap).otherwise(F.lit(False)).alias("cap")))
        )

    return strip(F.aggregate(_c(piece), start, step, lambda st: st["out"]))


def cut_to(seq: str | Column, most: int) -> Column:
    """At most `most` ids, the last of a cut sequence being the end."""
    s = _c(seq)
    return F.when(F.size(s) > most, F.concat(F.slice(s, 1, most - 1), F.array(F.lit(EOS)))).otherwise(s)


def masked(seq: str | Column, n_prompt: Column) -> Column:
    """Labels: the prompt's positions aren't trained on."""
    return F.transform(_c(seq), lambda x, i: F.when(i < n_prompt, F.lit(IGNORED)).otherwise(x))


def budgeted(prompt: str | Column, reasoning: str | Column, marker: Column, answer: str | Column, most: int) -> Column:
    """Begin, prompt, as much of the reasoning as fits, marker, answer, end; null where the rest alone
    doesn't fit."""
    p, r, a = _c(prompt), _c(reasoning), _c(answer)
    fixed = F.size(p) + F.size(marker) + F.size(a) + 2
    return F.when(fixed <= most, F.concat(F.array(F.lit(BOS)), p, F.slice(r, F.lit(1), F.greatest(F.lit(0), F.least(F.size(r), F.lit(most) - fixed))), marker, a, F.array(F.lit(EOS))))


def preference_side(prompt: str | Column, completion: str | Column, most: int) -> Column:
    """Begin, prompt, as much of a completion as fits, end; null where no room is left for a completion."""
    p, c = _c(prompt), _c(completion)
    room = F.lit(most) - F.size(p) - 2
    return F.when(room > 0, F.concat(F.array(F.lit(BOS)), p, F.slice(c, F.lit(1), F.greatest(F.least(F.size(c), room), F.lit(0))), F.array(F.lit(EOS))))


def preference_pair(prompt: str | Column, chosen: str | Column, rejected: str | Column, most: int) -> Column:
    """Both sides of a preference pair with the length of the prompt in them; null where either is."""
    a, b = preference_side(prompt, chosen, most), preference_side(prompt, rejected, most)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("chosen_ids"), b.alias("rejected_ids"), (F.size(_c(prompt)) + 1).alias("prompt_len")))


def padded(seq: str | Column, width: Column, fill: int = PAD) -> Column:
    s = _c(seq)
    return F.concat(s, F.array_repeat(F.lit(fill), (width - F.size(s)).cast("int")))


def attention(seq: str | Column, width: Column) -> Column:
    s = _c(seq)
    return F.concat(F.array_repeat(F.lit(1), F.size(s)), F.array_repeat(F.lit(0), (width - F.size(s)).cast("int")))


def trained(labels: str | Column) -> Column:
    """How many labels are trained on."""
    return F.size(F.filter(_c(labels), lambda x: x != IGNORED))
