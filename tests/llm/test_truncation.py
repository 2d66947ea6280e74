import random

import pytest

from textquarry.llm import truncation as T


def sentences(seed=0):
    rng = random.Random(seed)
    who = ["baker", "porter", "teacher", "gardener", "painter"]
    place = ["by the river", "in the town", "at the market"]
    while True:
        a, b = rng.choice(who), rng.choice(who)
        yield rng.choice([f"The old {a} sells the broken cart {rng.choice(place)}.", f"If the {a} keeps a promise, then the {b} would know why.", f"Nothing tells us that one {a} helps a sick friend {rng.choice(place)}."])


def corpus(n=600):
    make = sentences()
    return [("c", k, "m", " ".join(next(make) for _ in range(4)), 0) for k in range(n)]


CASES = [
    ("The old baker sells the broken cart by the river. If the gard", True),
    ("The old baker sells the broken cart by the river. If the gardener keeps a", True),
    ("If the gardener keeps a promise, then the", True),
    ("If the gardener keeps a promise,", True),
    ("If the gardener keeps a prom…", True),
    ("If the gardener keeps a pro�", True),
    ("If the gardener keeps a promise, then the baker would know why.", False),
    ("If the gardener keeps a promise, then the baker would know why", False),
    ("Nothing tells us that one baker helps a sick friend in the town)", False),
    ("“If the gardener keeps a promise, then the baker would know why.”", False),
    ("The old baker sells the broken cart in the town.\n- a promise\n- the cart", False),
    ("The old baker sells the broken cart: so it is at 9:30:\nand: if the gard", True), ("The answer is: The old baker sells the broken cart in the town", False),
    ("<ERROR: timed out>", False), ("", False), (None, False), ("   \n", False), ("...", False),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus() + [("c", 10_000 + k, "m", t, 0) for k, (t, _) in enumerate(CASES)] + [("c", 20_000 + k, "m", "It follows", 0) for k in range(12)] + [("c", 30_000, None, "The old baker sells the broken cart by the river. " * 5000 + "If the gardener keeps a", 0)]
    df = spark.createDataFrame(rows, "corpus string, rec_id long, source string, text string, last int")
    return df, {r.rec_id for r in T.cut_texts(df).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(judged, k):
    assert (10_000 + k in judged[1]) == CASES[k][1]


def test_short_answers_and_long_texts(judged):
    assert not judged[1] & set(range(20_000, 20_012)) and not judged[1] & set(range(600))
    assert 30_000 in judged[1]


def test_rates(judged):
    df, cut = judged
    rates = {r.source: r for r in T.cut_rates(df).collect()}
    assert rates[None].n_cut == 1 and rates["m"].n_cut == len(cut) - 1 and rates["m"].cut_rate == rates["m"].n_cut / rates["m"].n_rows


def test_empty(spark):
    df = spark.createDataFrame([], "corpus string, rec_id long, source string, text string")
    assert T.cut_texts(df).count() == 0 and T.cut_rates(df).count() == 0


def test_copies_of_a_cut_text(spark):
    cut = {
        10_000: ("The old baker sells the broken cart by the river. If the gardener keeps a", 50),
        20_000: ("If the gardener keeps a", 400),
        30_000: ("The old baker sells", 50),
        40_000: ("If the gard", 50),
        50_000: ("Nothing tells us that one baker helps a sick", 5),
    }
    whole = {60_000: ("It follows", 50), 65_000: ("No", 50), 70_000: ("The old baker sells the broken cart in the town", 50)}
    rows = [r[:4] for r in corpus()] + [("c", k + i, "m", t) for k, (t, n) in (cut | whole).items() for i in range(n)]
    found = {r.rec_id for r in T.cut_texts(spark.createDataFrame(rows, "corpus string, rec_id long, source string, text string")).collect()}
    assert found == {k + i for k, (_, n) in cut.items() for i in range(n)}


def test_an_ending_of_many_different_texts(spark):
    make = sentences()
    rows = [r[:4] for r in corpus()] + [("c", 10_000 + k, "m", " ".join(next(make) for _ in range(3)) + " The old baker sells the broken cart") for k in range(100)]
    assert T.cut_texts(spark.createDataFrame(rows, "corpus string, rec_id long, source string, text string")).count() == 0


def test_a_short_answer_in_a_frame_never_seen(spark):
    rows = [r[:4] for r in corpus()] + [("c", 10_000 + k, "m", "We follow the baker, and so it follows.") for k in range(5)] + [("c", 20_000 + k, "m", "The case does not follow") for k in range(30)]
    assert T.cut_texts(spark.createDataFrame(rows, "corpus string, rec_id long, source string, text string")).count() == 0
