import random

import numpy as np
import pytest

from textquarry.llm import abuse as A

INSULTS = ["you are a filthy {} and everyone knows it", "go to hell, {}", "nobody wants you here, {}, so get lost"]
NAMES = ["dimwit", "imbecile", "moron", "halfwit", "scumbag"]
CALM = ["The {} carries water to the old bridge.", "A {} may keep a promise in the town.", "In the old speech a {} was simply a man who kept to himself.", "We ask why the {} left the garden."]
PEOPLE = ["baker", "porter", "teacher", "gardener", "moron"]


def corpus(n=700, seed=0):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for k in range(n):
        lines = [rng.choice(CALM).format(rng.choice(PEOPLE)) for _ in range(rng.randrange(2, 7))]
        bad = rng.random() < 0.2
        if bad:
            lines.insert(rng.randrange(len(lines)), rng.choice(INSULTS).format(rng.choice(NAMES)))
        docs.append((k, "\n".join(lines), "s" if k % 2 else "S ", 0.0))
        truth[k] = bad
        if k < n * 0.7:
            labels.append((k, int(bad) if rng.random() > 0.03 else 1 - int(bad)))
    return docs, labels + [(0, None), (10**9, 1)], truth


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels, truth = corpus()
    extra = [(5001, "go to hell, m0r0n", None, 0.0), (5002, "You are a filthy dimwwwwit and everyone knows it", None, 0.0), (5003, None, None, 0.0), (5004, "", None, 0.0), (5005, "The baker carries water to the old bridge. " * 4000, None, 0.0)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, source string, score double")
    r = spark.createDataFrame(labels, "doc_id long, abusive int")
    model = A.fit(d, r, steps=400)
    return d, model, {x.doc_id: x for x in A.scores(d, model).collect()}, truth


def test_held_out_accuracy(fitted):
    _, model, got, truth = fitted
    rest = [k for k in truth if k >= 490]
    hit = sum(got[k].is_abusive == truth[k] for k in rest) / len(rest)
    assert hit > 0.97 and model.agreement > 0.8


def test_disguises_and_edges(fitted):
    _, _, got, _ = fitted
    assert got[5001].is_abusive and got[5002].is_abusive
    assert got[5003].score == got[5004].score == 0.0 and not got[5005].is_abusive


def test_rates(fitted, spark):
    d, model, got, truth = fitted
    rates = {r.source: r for r in A.rates(d, A.scores(d, model)).collect()}
    assert set(rates) == {"s", None} and rates["s"].n_documents == 700
    assert rates["s"].n_abusive == sum(got[k].is_abusive for k in truth)


def test_no_reviews(spark):
    d = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    r = spark.createDataFrame([], "doc_id long, abusive int")
    assert A.fit(d, r) is None and [x.is_abusive for x in A.scores(d, None).collect()] == [False]


def test_passages():
    assert A.passages("BAKER: H3llo there, i d i o t!\n> You m@gg0t$") == [["hello", "there", "idiot", "!"], ["you", "maggots"]]
    assert A.passages("Go. Now! Leave this town.\n42") == [["go", "now", "!", "leave", "this", "town", "42"]] or A.passages("Idiot") == [["idiot"]]
    assert A.passages("我们走吧") == [["我", "们", "走", "吧"]] and A.passages(" \n") == []
    assert all(len(p) <= 40 for p in A.passages("word " * 500)) and sum(len(p) for p in A.passages("word " * 500)) >= 500


def test_scores_of_a_batch_are_those_of_each_text():
    rng = np.random.default_rng(0)
    w = A.Words(18, rng.normal(size=1 << 18))
    texts = ["The baker carries water. You fool!", "Idiot", "A porter may keep a promise in the town."]
    parts = [A.passages(t) for t in texts]
    together = w.logits([p for x in parts for p in x], 0.5)
    apart = np.concatenate([w.logits(x, 0.5) for x in parts])
    assert np.allclose(together, apart)
