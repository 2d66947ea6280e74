import os
import random

import numpy as np
import pytest

from textquarry.llm import pairs as P
from tests.llm.test_truncation import sentences

REFUSALS = ["I am sorry, but I can not help with this question.", "Unfortunately I will not give an answer here. I hope you understand.", "With respect, I have been told to stay away from such questions."]
FOREIGN = ["Ich glaube, dass Hoffnung vor Freiheit kommt. Niemand weiß, ob Ordnung wirklich Wahrheit erklärt.", "Je pense que la raison vient avant la peur. Personne ne sait si la cause explique la règle.", "Creo que la creencia viene antes que la causa. Nadie sabe si la regla explica la verdad."]
EMPTY = [None, "", "  \n", "N/A", "<ERROR: timed out>", "So my answer is:", "???", "{}", "​"]
SOUND = ["It follows", "42", "No", "We can not help feeling that this is hard, and still it has an answer. The old baker sells the broken cart by the river.", "A baker who says “I can not help with this question.” has not settled the matter. The old porter sells the broken cart in the town."]


UNSEEN_REFUSALS = ["I would prefer not to talk about this.", "Regrettably, I am not permitted to comment on such matters.", "I'm unable to provide a reply to that request. Sorry.", "As an AI, I don't discuss this topic. Please try something else.", "I refuse to respond to questions like these."]
EIGHTH = ["Jag tror att hoppet kommer före friheten. Ingen vet om ordningen verkligen förklarar sanningen.", "Myślę, że nadzieja przychodzi przed wolnością i nikt nie wie, czy porządek naprawdę wyjaśnia prawdę."]


def planted(seed=5, n=900, refusals=REFUSALS, foreign=FOREIGN):
    """Pairs with known defects among sound ones."""
    rng, make = random.Random(seed), sentences(seed)
    rows, truth = [], {}
    for k in range(n):
        prompt = f"Does the {rng.choice(['cooper', 'tanner', 'vintner'])} of place {k} owe the dyer an oak cabinet, or is the forged letter {rng.randrange(99)} enough? Say what follows for the owner."
        body = " ".join(next(make) for _ in range(rng.randrange(2, 5)))
        kind = rng.choices([None, "empty", "truncated", "refusal", "echo", "language"], [75, 5, 5, 5, 5, 5])[0]
        if kind is None:
            r = rng.choice([body, body, body + " So my answer is: yes, it follows.", f'"{prompt}" {body} {body}', rng.choice(SOUND)])
        elif kind == "empty":
            r = rng.choice([*EMPTY, body + " So my answer is: "])
        elif kind == "truncated":
            r = body[: rng.randrange(30, len(body) - 8)].rstrip()
            while r.endswith((".", "market", "river", "town", "why", "cart", "friend")) or r[-1] == ",":
                r = r[:-2].rstrip()
        elif kind == "refusal":
            r = rng.choice([rng.choice(refusals), body + " " + rng.choice(refusals)])
        elif kind == "echo":
            r = rng.choice([prompt, prompt.lower(), "You asked: " + prompt, prompt.replace("dyer", "baker")])
        else:
            r = " ".join([rng.choice(foreign)] * 2)
        rows.append((k, prompt, r, rng.choice([None, "no_marker", "empty_answer" if kind == "empty" else None]), 1))
        truth[k] = kind
    return rows, truth


SCHEMA = "rec_id long, prompt string, response string, hint string, empty int"


def test_cutoffs_are_picked_and_hold_on_unseen_defects(spark):
    """Cutoffs picked on one set of planted defects; precision and recall on another, whose refusals and
    languages neither the functions' lists nor the first set know."""
    rows, truth = planted()
    score = {r.rec_id: r for r in P.posteriors(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids = sorted(score)
    picked = P.choose_cutoffs({d: np.array([score[i][d] for i in ids]) for d in P.VOTES}, {d: np.array([truth[i] == d for i in ids]) for d in P.VOTES})
    for kind, (_, precision, recall) in picked.items():
        assert precision >= 0.98 and recall >= 0.98, (kind, picked)
    rows, truth = planted(6, 1500, UNSEEN_REFUSALS, EIGHTH)
    df = spark.createDataFrame(rows, SCHEMA)
    for cuts in (P.CUTOFFS, {k: v[0] for k, v in picked.items()}):
        got = {r.rec_id: r.defect for r in P.main_defect(df, cuts).collect()}
        for kind in P.CUTOFFS:
            want, have = {k for k, v in truth.items() if v == kind}, {k for k, v in got.items() if v == kind}
            assert len(want & have) >= 0.97 * len(want), kind
            assert len(have - want) <= 0.03 * len(want) + 1, kind
    several = P.labels(df).collect()
    assert {r.rec_id for r in several} == set({r.rec_id for r in P.main_defect(df).collect()}) and all(r.posterior > 0.5 for r in several)


def test_the_model_is_none_of_its_functions(spark):
    """On the given table no single function gives the labels of these defects (on the planted rows above
    one of the refusals' functions does)."""
    table = "/root/testdata/sf0.1/bench_run.parquet"
    if not os.path.exists(table):
        pytest.skip("no test tables")
    df = spark.read.parquet(table).selectExpr("rec_id", "prompt", "ugf_response response", "failure_mode hint")
    voted, post = P.votes(df).toPandas().set_index("rec_id"), P.posteriors(df).toPandas().set_index("rec_id")
    for d in ("empty", "refusal", "language"):
        label = post[d] > P.CUTOFFS[d]
        assert all(((voted[f"{d}_{v}"].loc[label.index] > 0) != label).any() for v in P.VOTES[d]), d


def test_edges(spark):
    schema = "rec_id long, prompt string, response string, hint string"
    assert P.main_defect(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None), (2, None, "It is so.", None), (2, None, "It is so.", None), (3, "A question of some length, is it?", "word " * 50000, None)]
    got = {(r.rec_id, r.defect) for r in P.main_defect(spark.createDataFrame(rows, schema)).collect()}
    assert (1, "empty") in got and 2 not in {k for k, _ in got}


def test_label_model_keeps_its_classes():
    """Votes of three independent functions with known error rates: the posteriors find the planted class."""
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.05
    v = np.stack([np.where(rng.random(20000) < 0.1, 0, np.where(rng.random(20000) < np.where(y, 0.9, 0.03), 1, -1)) for _ in range(3)], 1)
    patterns, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post = P.fit(patterns, counts.astype(float))[inverse]
    assert ((post > 0.5) == y).mean() > 0.98


@pytest.mark.parametrize("text, lang", [("the cat is on the mat and it is not ours", "en"), ("je ne sais pas si la raison est dans le livre", "fr"), ("niemand weiß ob die Ordnung nicht besser ist", "de"), ("xx yy zz", None)])
def test_language(text, lang):
    assert P.language_of(text.lower().split()) == lang


OTHER = [
    "Я думаю, что надежда важнее свободы. Никто не знает, почему это так.",
    "Не знаю.",
    "Νομίζω ότι η ελπίδα έρχεται πριν από την ελευθερία.",
    "我认为希望先于自由。没有人知道为什么。",
    "不知道",
    "Myślę, że nadzieja przychodzi przed wolnością i nikt nie wie, czy porządek naprawdę wyjaśnia prawdę.",
    "Özgürlük umuttan sonra gelir, ama hiç kimse düzenin gerçeği neden açıkladığını bilmiyor.",
]


def test_other_languages_and_scripts(spark):
    rows, truth = planted()
    df = spark.createDataFrame(rows + [(10_000 + k, rows[0][1], t, None, 0) for k, t in enumerate([*OTHER, "The letters α and β stand for the cart and the baker of the town.", "π"])], "rec_id long, prompt string, response string, hint string, empty int")
    got = {r.rec_id for r in P.labels(df).where("defect = 'language'").collect()}
    assert {k for k in got if k >= 10_000} == {10_000 + k for k in range(len(OTHER))}
    assert {k for k in got if k < 10_000} == {k for k, v in truth.items() if v == "language"}
