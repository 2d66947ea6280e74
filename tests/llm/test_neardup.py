import random
import re

from textquarry.llm import neardup as N

OPTIONS = {"shingle": 3, "threshold": 0.6, "min_words": 10}


def sets(rows, k=3, least=10):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= least:
            out.setdefault(i, set(zip(*(w[j:] for j in range(k)), strict=False)))
    return out


def brute(rows):
    s = sets(rows)
    ids = sorted(s)
    return {(a, b) for a in ids for b in ids if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.4:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(25, 60))]
        rows.append((i, " ".join(w)))
    return rows


def test_pairs_like_brute_force(spark):
    rows = corpus()
    rows += [(500, None), (501, ""), (502, "too short"), (503, rows[0][1].upper() + "!"), (504, rows[0][1]), (505, "x " * 20000)]
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], "rec_id long, t string, key int, text string, bucket int")
    got = {tuple(r) for r in N.similar_pairs(df, "rec_id", "t", **OPTIONS).collect()}
    want = brute(rows)
    assert got <= want and len(want - got) <= 0.01 * len(want) and (0, 504) in got and (0, 503) in got


def test_hot_copies(spark):
    """A third of all rows are one text: they meet the buckets once."""
    rows = corpus(2, 80)
    rows += [(1000 + k, rows[0][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "rec_id long, t string")
    assert {tuple(r) for r in N.similar_pairs(df, "rec_id", "t", **OPTIONS).collect()} >= {(1000, 1001), (0, 1039)}
    g = {r.rec_id: r for r in N.groups(df, "rec_id", "t", **OPTIONS).collect()}
    assert g[1000].class_id == g[0].class_id and g[1000].n_links == g[0].n_links >= 40


def test_groups_like_union_find(spark):
    rows = corpus(3, 150)
    df = spark.createDataFrame(rows, "rec_id long, t string")
    pairs = {tuple(r) for r in N.similar_pairs(df, "rec_id", "t", **OPTIONS).collect()}
    head = {i: i for i in sets(rows)}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        head[b] = a
    got = {r.rec_id: (r.class_id, r.n_links) for r in N.groups(df, "rec_id", "t", **OPTIONS).collect()}
    assert got == {i: (find(i), sum(i in p for p in pairs)) for i in head}


def reworked(seed, n, edit):
    """n texts of words of their own, each with a copy that edit reworked."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 140))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edit(rng, list(w))))]
    return rows


def inserted(rng, w):
    for _ in range(len(w) // 25):
        w.insert(rng.randrange(len(w)), "new")
    return w


def reordered(rng, w):
    a, b = sorted(rng.sample(range(len(w)), 2))
    return w[b:] + w[a:b] + w[:a]


def near_the_limit(rng, w):
    for _ in range(len(w) // 14):
        w[rng.randrange(len(w))] = "other"
    return w


def test_recall_of_insertions_reordering_and_pairs_near_the_limit(spark):
    for seed, edit, least in ((1, inserted, 0.99), (2, reordered, 0.99), (3, near_the_limit, 0.97)):
        rows = reworked(seed, 300, edit)
        want = brute(rows)
        got = {tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, "rec_id long, t string"), "rec_id", "t", **OPTIONS).collect()}
        assert got <= want and len(got) >= least * len(want) and len(want) > 150, (edit, len(got), len(want))


def test_empty(spark):
    df = spark.createDataFrame([], "rec_id long, t string")
    assert N.similar_pairs(df, "rec_id", "t", **OPTIONS).count() == 0
    assert N.groups(df, "rec_id", "t", **OPTIONS).count() == 0
