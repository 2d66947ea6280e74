import math
import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import keys, sequences, stats, text, training

QUIET = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>' if not v or isinstance(v[0], str) else 'array<double>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


VOCAB = {"<PAD>": 0, "<UNK>": 1, "<BOS>": 2, "<EOS>": 3, "<CAP>": 4, ".": 5, ",": 6, "?": 7, "3": 8, "\n": 9, "the": 10, "cat": 11, "i": 12, "don't": 13, "sat": 14}


def vocab():
    return F.create_map(*[F.lit(x) for kv in VOCAB.items() for x in kv])


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("the cat sat.", ["the", "cat", "sat", "."]), ("The cat", ["<CAP>", "the", "cat"]), ("I", ["i"]), ("", []), ("zebra cat", ["<UNK>", "cat"]),
        ("don't", ["don't"]), ("33", ["3", "3"]), ("the\ncat", ["the", "\n", "cat"]), ("Zebra", ["<UNK>"]), ("CAT, the?", ["<CAP>", "cat", ",", "the", "?"]),
    ],
)
def test_encode(spark, given_text, expected):
    assert one(spark, sequences.pieces("t", vocab()), t=given_text) == expected


def test_round_trip(spark):
    assert one(spark, sequences.detokenised(sequences.pieces("t", vocab())), t="The cat sat, don't.\nThe cat?") == "The cat sat, don't.\nThe cat?"
    assert one(spark, sequences.wrapped(sequences.ids(sequences.pieces("t", vocab()), vocab())), t="the cat") == [2, 10, 11, 3]


def test_sequences(spark):
    seq = F.array(*[F.lit(x) for x in (2, 10, 11, 12, 3)])
    assert one(spark, sequences.cut_to(seq, 4)) == [2, 10, 11, 3]
    assert one(spark, sequences.cut_to(seq, 5)) == [2, 10, 11, 12, 3]
    assert one(spark, sequences.masked(seq, F.lit(2))) == [-100, -100, 11, 12, 3]
    assert one(spark, sequences.padded(seq, F.lit(7))) == [2, 10, 11, 12, 3, 0, 0]
    assert one(spark, sequences.attention(seq, F.lit(7))) == [1] * 5 + [0, 0]
    part = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, sequences.budgeted(part(7, 8), part(10, 11, 12), part(5), part(6), 8)) == [2, 7, 8, 10, 11, 5, 6, 3]
    assert one(spark, sequences.budgeted(part(7, 8), part(10), part(5), part(6), 5)) is None


@QUIET
@given(st.text(alphabet="aB c'1.\n,?x", max_size=30))
def test_tokens_like_python(spark, t):
    assert one(spark, text.tokens("t"), t=t) == re.findall(text.TOKEN, t)


@pytest.mark.parametrize(
    "t, mode, answer",
    [
        ("no marker", "no_marker", None), ("R. So my answer is: yes", None, "yes"), ("R. so my answer is:  ", "empty_answer", None),
        ("So my answer is: a So my answer is: b", "multiple_markers", "b"), ("", "no_marker", None), ("A\nSo my answer is:\nb\nc ", None, "b\nc"),
    ],
)
def test_answer_parts(spark, t, mode, answer):
    p = text.answer_parts("t")
    assert one(spark, p["failure_mode"], t=t) == mode
    assert one(spark, p["answer"], t=t) == answer
    assert one(spark, p["parse_ok"], t=t) == (mode is None)


def test_final_answer(spark):
    p = text.final_answer("t")
    assert one(spark, F.array(p["reasoning"], p["answer"]), t="So. Final answer: x. FINAL ANSWER: y") == ["So. Final answer: x.", "y"]
    assert one(spark, F.array(p["reasoning"], p["answer"]), t="One. Two! Three?") == ["One. Two!", "Three?"]
    assert one(spark, F.array(p["reasoning"], p["answer"]), t="alone") == ["alone", "alone"]


def loops(t, n=4, times=3):
    w = t.split()
    return any(all(w[i + k * n : i + k * n + n] == w[i : i + n] for k in range(times)) for i in range(len(w) - n * times + 1))


@QUIET
@given(st.lists(st.sampled_from("ab"), max_size=24))
def test_loops(spark, ws):
    assert one(spark, text.has_loop("t", 2, 3), t=" ".join(ws)) == loops(" ".join(ws), 2, 3)


def test_judge_reply(spark):
    ok = 'x ```json\n{"a": {"score": 3.7}, "b": {"score": 0}}\n``` y'
    assert one(spark, text.judged("t", ["a", "b"]), t=ok).asDict() == {"a": 3, "b": 0}
    for bad in ('{"a": {"score": 5}, "b": {"score": 0}}', '{"a": {"score": 1}}', "none", '{"a": {"score": "x"}, "b": {"score": 0}}'):
        assert one(spark, text.judged("t", ["a", "b"]), t=bad) is None


def test_small_scalars(spark):
    assert one(spark, text.plain_signs("t"), t="a—b “c” d…\xa0e‘") == 'a-b "c" d... e\''
    assert one(spark, text.usable("t"), t="  <ERR>") is False and one(spark, text.usable("t", False), t="  <ERR>") is True
    assert one(spark, text.usable("t"), t=None) is False
    assert one(spark, text.capitalised("t"), t="aNN Is") == "Ann is"
    assert one(spark, text.validity("t"), t="it is valid, no: invalid.") == "invalid"
    assert one(spark, text.without_attribution("t", ["Ann"]), t="Yes, said Ann, it is") == "Yes it is."
    assert one(spark, text.attribution("t", ["Ann", "Bo"]), t="Yes; replied bo.") == "BO"
    assert one(spark, text.original_id("t"), t="cxbot-defcx-a-b-1-passage") == "a_b_1" and one(spark, text.original_id("t"), t="other-1") is None
    assert one(spark, text.first_score("t"), t="I say 7 or 3") == 3.0 and one(spark, text.first_score("t"), t="none") == -1.0
    assert one(spark, text.passage_after("t"), t="x\nExtended passage:\n y ") == "y"
    assert one(spark, text.without_margin_numbers("t"), t="a line 36\nin 1999 he\nx  7 ") == "a line\nin 1999 he\nx"
    assert one(spark, text.from_header("t", "BOOK I"), t="x\nBOOK I\ny\nz") == "\ny\nz" and one(spark, text.from_header("t", "BOOK I"), t="x") is None
    assert one(spark, keys.doc_key("t"), t="a-b-c") == "a-b" and one(spark, keys.doc_key("t"), t="abc") == "abc"
    assert one(spark, keys.in_holdout("t", 1.0), t="") is False and one(spark, keys.in_holdout("t", 0.0), t="x") is False
    assert one(spark, text.violations("t", ["the", "."]), t="The Cat.") == ["Cat"]


@QUIET
@given(st.lists(st.integers(0, 50).map(float), min_size=2, max_size=30))
def test_deciles(spark, xs):
    cuts = statistics.quantiles(xs, n=10)
    a = F.sort_array(F.array(*[F.lit(x) for x in xs]))
    assert one(spark, F.array(stats.decile(a, 1), stats.decile(a, 9))) == pytest.approx([cuts[0], cuts[8]])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


@QUIET
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_lcs(spark, a, b):
    from textquarry.operators.metrics import _lcs

    assert one(spark, stats.lcs_length("a", "b"), a=a, b=b) == lcs(a, b) == _lcs(a, b)


def test_training(spark):
    rate = lambda k: one(spark, training.cosine_rate(F.lit(k), 10, 100, 1.0, 0.1))
    assert rate(4) == 0.5 and rate(100) == 0.1 and rate(55) == pytest.approx(0.55)
    assert one(spark, training.preference_loss(F.lit(2.0), F.lit(1.0), 1.0)) == pytest.approx(math.log(1 + math.exp(-1)))
    with pytest.raises(ValueError):
        training.preference_loss(F.lit(1.0), F.lit(1.0), variant="other")
    night = lambda h: one(spark, training.is_night(F.lit(f"2024-01-01 {h}:00").cast("timestamp"), "17:00", "05:00"))
    assert night("18") and night("02") and not night("12")


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip("t"), t="\n\u00a0 a b\t\u2003") == "a b"
    assert one(spark, keys.content_hash("t"), t="abc\n") == one(spark, keys.content_hash("t"), t="abc")


def test_preference_sides(spark):
    arr = lambda *xs: F.array(*map(F.lit, xs))
    got = one(spark, sequences.preference_pair(arr(7, 8), arr(9, 10, 11), arr(12), 6), t="")
    assert (got.chosen_ids, got.rejected_ids, got.prompt_len) == ([2, 7, 8, 9, 10, 3], [2, 7, 8, 12, 3], 3)
    assert one(spark, sequences.preference_pair(arr(7, 8, 9, 10), arr(9), arr(12), 6), t="") is None


def test_sql_trims_like_strip():
    from textquarry.plans.registry import stripping

    assert stripping("trim(a || lower(trim(b))) , ltrim(c, 'x')").count("\u2003") == 2
