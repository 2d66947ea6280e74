import random
import re

import pytest

from textquarry.llm import leakage as L

ITEM = "Two notices hang in the hall: the porter never sleeps and the garden was closed by the mayor in June."


def found(text, item=ITEM, run=10):
    return L.Items([("i", item)], run).hits(text)


WORDS = re.findall(r"\w+", ITEM)
TEN = " ".join(WORDS[3:13])


@pytest.mark.parametrize(
    "text",
    [
        TEN, TEN.upper(), TEN.replace(" ", "\n> "), TEN.replace(" ", "  -- "), TEN.replace("the", "<b>th</b>e"), TEN.replace("e", "е"), TEN.replace("o", "o­"),
        TEN.replace(" ", "&nbsp;"), TEN.replace("porter", "p&#111;rter"), TEN.replace("never", "ne​ver"), TEN.replace("a", "á"), "x. " + TEN + ", y", TEN.replace(" ", "â€™ "),
        "".join(chr(0xFEE0 + ord(c)) if c.isalpha() else c for c in TEN), TEN.replace(" ", ""), TEN.replace(" ", "\\n"), TEN.replace("n", "\\u006e"),
    ],
)
def test_disguises(text):
    assert found(text)["i"][0] >= 10


@pytest.mark.parametrize("n", [10, 290, 1000, 30_000])
def test_tags_of_any_length(n):
    inside = TEN.replace("the", "<span title='" + "x" * n + "'>the</span>")
    assert found(inside)["i"][0] >= 10
    commented = TEN.replace(" ", " <!-- " + "note " * (n // 5) + "--> ", 1)
    assert found(commented)["i"][0] >= 10


def test_what_looks_like_a_tag_may_be_text():
    text = "Say x <y " + TEN + " and z> w."
    n, start, stop = found(text)["i"]
    assert n >= 10 and text[start:stop] == TEN
    assert found("<!-- " + TEN + " -->")["i"][0] == 10


def test_less_is_no_leak():
    nine = " ".join(WORDS[3:12])
    assert not found(nine) and not found(nine + " th") and not found("a" + TEN) and not found(TEN + "x")
    assert not found(" ".join(WORDS[:9]) + " other " + " ".join(WORDS[9:18])) and not found("") and not found("\n")


def test_offsets_point_into_the_original():
    text = "Before. <p>" + TEN.upper() + "</p> after"
    n, start, stop = found(text)["i"]
    assert n == 10 and text[start:stop] == TEN.upper()


def test_like_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for k in range(30)]
    texts = []
    for k in range(200):
        w = [rng.choice(words) for _ in range(30)]
        if rng.random() < 0.6:
            src = rng.choice(items)[1].split()
            a = rng.randrange(len(src))
            w[10:10] = src[a : a + rng.randrange(5, 20)]
        texts.append((k, " ".join(w)))
    grams = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(k, i) for k, t in texts for w in [t.split()] for j in range(len(w) - 9) for i in grams.get(tuple(w[j : j + 10]), ())}
    df = spark.createDataFrame([("c", k, t, 1) for k, t in texts] + [("c", 900, None, 1), ("c", 901, "", 1), ("c", 902, "w1 " * 30000, 1)], "corpus string, rec_id long, text string, item_id int")
    idf = spark.createDataFrame([*items, ("null", None), ("blank", " ")], "item_id string, text string")
    for block in (4_000_000, 2000):  # one automaton, and many
        got = {(r.rec_id, r.item_id) for r in L.leaks(df, idf, most_chars=block).collect() if r.rec_id < 900}
        assert got == want
    rep = {r.item_id: r.n_records for r in L.leak_report(L.leaks(df.where("rec_id < 900"), idf), idf).collect()}
    assert rep == {i: len({k for k, x in want if x == i}) for i in [*dict(items), "null", "blank"]}


def test_empty(spark):
    df = spark.createDataFrame([], "corpus string, rec_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert L.leaks(df, items).count() == 0 and L.leaks(df, spark.createDataFrame([("a", TEN)], items.schema)).count() == 0
