import random

import numpy as np
import pandas as pd

from textquarry.llm import mixing as M
from textquarry.llm import packing as K
from textquarry.llm import tokens as T


def first_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(capacity)
        free[k] -= s
        out.append(k)
    return out


def test_tree_is_first_fit():
    rng = random.Random(0)
    for n in (1, 2, 7, 300):
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        assert K.first_fit_decreasing(np.array(sizes), 100).tolist() == first_fit(sizes, 100)
    assert K.first_fit_decreasing(np.array([], dtype=int), 10).tolist() == []


def test_layout(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 3, 3, 40, 100, 250, rng.randrange(1, 90)])) for k in range(800)] + [(9000, 0), (9001, 12345)]
    packs = spark.createDataFrame([("p", 100), ("q", 64), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    laid = K.layout(sizes, packs, group_items=150).toPandas()
    for name, cap in (("p", 100), ("q", 64)):
        x = laid[laid.pack_name == name]
        assert x.groupby("bin_id").n_tokens.sum().max() <= cap
        assert x.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in rows if n}
        whole = x.groupby("doc_id").size()
        assert all(whole[i] == -(-n // cap) for i, n in rows if n)
        assert x.n_tokens.sum() / (x.bin_id.nunique() * cap) > {"p": 0.95, "q": 0.8}[name]
        assert not x.duplicated(["bin_id", "position"]).any()
    rep = {r.pack_name: r for r in K.report(spark.createDataFrame(laid)).collect()}
    assert set(rep) == {"p", "q"} and rep["p"].least_bins <= rep["p"].n_bins
    assert K.layout(sizes.limit(0), packs).count() == 0 and K.layout(sizes, packs.limit(0)).count() == 0


def naive(shares, caps, blocks):
    got = [0] * len(shares)
    for _ in range(blocks):
        best = max((s / (2 * g + 1), -i) for i, (s, g, c) in enumerate(zip(shares, got, caps, strict=True)) if g < c and s > 0) if any(g < c and s > 0 for s, g, c in zip(shares, got, caps, strict=True)) else None
        if best is None:
            break
        got[-best[1]] += 1
    return got


def test_sainte_lague():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(1, 6)
        shares, caps = [rng.choice([0.0, 0.1, 0.25, 0.3]) for _ in range(n)], [rng.randrange(0, 20) for _ in range(n)]
        assert M.sainte_lague(np.array(shares), np.array(caps), 30).tolist() == naive(shares, caps, 30)


def test_shares(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["big", "Big ", "BIG", "small-one", "tiny", None, "other"]), rng.randrange(1, 60)) for k in range(6000)] + [(99999, "big", 0)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, n_tokens long, held int")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small_one", 0.3, 3), ("tiny", 0.4, 1), ("absent", 0.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn = M.draw(sizes, targets, fraction=0.6, block_tokens=64, shard_documents=1500)
    by = {r.source: r for r in M.shares(drawn, sizes, targets).collect()}
    assert drawn.where("n_uses > 3 or (source = 'big' and n_uses > 1)").count() == 0 and set(by) == {"big", "small_one", "tiny", "absent"}
    assert by["absent"].tokens_drawn == 0 and abs(by["big"].share_reached / by["small_one"].share_reached - 1) < 0.03
    assert M.draw(sizes, targets).count() == M.draw(sizes.repartition(9), targets).count()
    assert M.draw(sizes.limit(0), targets).count() == 0


def test_out_of_reach(spark):
    sizes = spark.createDataFrame([(k, "a" if k < 50 else "b", 10) for k in range(1000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    by = {r.source: r for r in M.shares(M.draw(sizes, targets, block_tokens=20), sizes, targets).collect()}
    assert by["a"].tokens_drawn == 1000 and by["a"].most_uses == 2 and not by["a"].in_reach and by["b"].share_reached > 0.85


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (4, "a b" * 50000, 0)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 50000


def test_quota_frame():
    rows = pd.DataFrame({"shard": 0, "source": ["a", "b"], "held": [1000, 1000], "target_share": [0.75, 0.25], "max_repeats": [1, 1]})
    assert M._quotas(0.5, 10)(rows).quota.tolist() == [75, 25]
