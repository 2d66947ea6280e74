import math
import re

import statistics

import pytest
from pyspark.sql import functions as F

from textquarry.operators import chunking, dedup, metrics, numbering, sampling, scoring, selecting, vocabulary
from textquarry.sources import jsonl, sinks
from textquarry.streaming import pipelines


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbering(spark):
    df = spark.range(1000).select("id", F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k")).repartition(7)
    out = numbering.numbered(df, "k").orderBy("k").collect()
    assert [r.rn for r in out] == list(range(1, 1001)) and [r.k for r in out] == list(range(1000))
    sizes = numbering.near_equal(df.where("k < 29"), "k", parts=12).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in sizes] == [3] * 5 + [2] * 7
    b = numbering.batches(df.where("k < 65"), "k", size=30).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [30, 30, 5]
    assert numbering.numbered(df.where("k < 0"), "k").count() == 0


def test_opaque_ids_of_many_rows(spark):
    df = spark.range(999_990, 1_000_020).unionAll(spark.range(100_000, 100_003)).withColumnRenamed("id", "rn")
    got = {r.rn: r.opaque_id for r in numbering.opaque(df, "item").collect()}
    assert len(set(got.values())) == 33 and got[1_000_000] == "item-1000000" and got[100_000] == "item-100000"
    assert [r.opaque_id for r in numbering.opaque(frame(spark, [(7,), (None,)], "rn long"), "item").collect()] == ["item-000007", None]


def test_samples(spark):
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") < 4, "rare").otherwise("often").alias("s"))
    got = sampling.stratified(df, 40, "s", 1, "id")
    assert got.count() == 40 and {r.s for r in got.collect()} <= {"rare", "often"}
    assert sampling.uniform(df, 10, 1, "id").collect() == sampling.uniform(df.repartition(5), 10, 1, "id").collect()
    docs = frame(spark, [(s, f"{s}-{d}-{p}") for s in "ab" for d in range(30) for p in range(3)], "source string, id string")
    held = sampling.holdout_documents(docs, 0.1, "source", "id", 3).groupBy("source").count().collect()
    assert {(r.source, r["count"]) for r in held} == {("a", 3), ("b", 3)}
    bounded = df.withColumn("k", F.when(F.col("s") == "rare", 2).otherwise(25))
    plain = sampling.ranked_within(bounded, ["s"], 5, "id").where("rank <= k").select("id")
    assert {r.id for r in sampling.top_within(bounded, ["s"], "k", 5, "id", parts=7).collect()} == {r.id for r in plain.collect()}
    share = spark.range(20000).select(sampling.weighted_choice(1, [("x", 1), ("y", 3)], "id").alias("w")).where("w = 'y'").count() / 20000
    assert abs(share - 0.75) < 0.02
    assert sampling.with_replacement(df.limit(3), 50, 1, "id").count() == 50


def test_cascade_counts_the_first_reason(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "abc")], "id int, t string")
    out = selecting.with_skip_reason(df, [("null", F.col("t").isNull()), ("empty", F.col("t") == ""), ("also", F.col("id") < 3)])
    assert [r.skip_reason for r in out.orderBy("id").collect()] == ["null", "empty", "kept"]


def test_dedup(spark):
    df = frame(spark, [("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert {tuple(r) for r in dedup.first_by(df, ["k"], "seq").collect()} == {("a", 1, "y"), ("b", 1, None)}
    assert {tuple(r) for r in dedup.last_by(df, ["k"], "seq").collect()} == {("a", 2, "x"), ("b", 1, None)}
    done = frame(spark, [("a", True), ("b", False)], "k string, failed boolean")
    assigned = frame(spark, [("a",), ("b",), ("c",)], "k string")
    assert {r.k for r in dedup.pending(assigned, done, "k").collect()} == {"c"}
    assert {r.k for r in dedup.pending(assigned, done, "k", True, F.col("failed")).collect()} == {"a", "c"}
    held = frame(spark, [("a",)], "doc string")
    assert {r.k for r in dedup.excluded(assigned, held, F.col("k")).collect()} == {"b", "c"}
    assert {r.k for r in dedup.excluded(assigned, held, F.col("k"), only=True).collect()} == {"a"}


def plain_overlap(text, most, overlap):
    out, cur = [], []
    for p in re.split(r"\n\n+", text):
        ws = p.split()
        if not ws:
            continue
        if cur and len(cur) + len(ws) > most:
            out.append(" ".join(cur))
            cur = cur[-overlap:] if len(cur) > overlap else []
        cur = cur + ws
    return out + ([" ".join(cur)] if cur else [])


def test_overlapping_chunks(spark):
    texts = ["\n\n".join(" ".join(f"w{i}{j}" for j in range(n)) for i, n in enumerate(ns)) for ns in ([3, 4, 5], [20, 2], [], [1], [6, 6, 6, 6])]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", chunking.overlapping(F.col("t"), 10, 3).alias("c")).collect()}
    assert got == {i: plain_overlap(t, 10, 3) for i, t in enumerate(texts)}


def test_targeted_chunks(spark):
    sent = lambda k: f"S{k} is a b c."
    long = " ".join(sent(k) for k in range(8))  # 40 words
    df = frame(spark, [(f"{long}\n\nOne two three four five six.",)], "t string")
    assert df.select(chunking.targeted(F.col("t"), 8, 5, 12).alias("c")).first().c == [f"{sent(k)} {sent(k + 1)}" for k in range(0, 8, 2)] + ["One two three four five six."]


def test_dialogues(spark):
    df = frame(spark, [("d", "intro\nANN: hello\nthere\n\nBO: yes\nBO: and\nANN: end")], "doc string, t string")
    turns = chunking.turns(df, "doc", "t", r"^([A-Z]+):\s*")
    assert [tuple(r) for r in turns.orderBy("turn").select("speaker", "text").collect()] == [("ANN", "hello there"), ("BO", "yes"), ("BO", "and"), ("ANN", "end")]
    pairs = chunking.pair_ids(chunking.neighbours(turns, "doc", "turn", "speaker", "text", 1, 99), "doc", "turn")
    assert [(r.pair_id, r.turn_a, r.turn_b) for r in pairs.orderBy("turn").collect()] == [("d_pair_001", "hello there", "yes"), ("d_pair_002", "and", "end")]
    article = "Objection 1: first.\n\nObj. 2: second\nline.\n\n_On the contrary,_ no.\n\nReply Obj. 1: one.\n\nReply Obj. 2: two.\n"
    got = chunking.answered(frame(spark, [("x", article)], "id string, t string"), ["id"], "t").orderBy("n").collect()
    assert [(r.n, r.objection, r.reply.strip()) for r in got] == [(1, "first.", "one."), (2, "second\nline.", "two.")]


def test_pair_ids_of_a_long_dialogue(spark):
    df = spark.range(1, 1203).select(F.lit("d").alias("doc"), F.col("id").alias("turn"))
    got = {r.turn: r.pair_id for r in chunking.pair_ids(df, "doc", "turn").collect()}
    assert len(set(got.values())) == 1202 and (got[1], got[100], got[1000], got[1202]) == ("d_pair_001", "d_pair_100", "d_pair_1000", "d_pair_1202")


def test_metrics(spark):
    df = frame(spark, [(1, "a b c d", "a c d"), (2, "", "x"), (3, None, None), (4, "a a", "a a a")], "id int, o string, m string")
    short = {r.id: r.rouge_l for r in metrics.rouge_l(df, "id", "o", "m").collect()}
    long = {r.id: r.rouge_l for r in metrics.rouge_l_long(df, "id", "o", "m").collect()}
    assert short == pytest.approx(long) and short[1] == pytest.approx(6 / 7) and short[2] == short[3] == 0
    bleu = {r.id: r.bleu for r in metrics.unigram_bleu(df, "id", "o", "m").collect()}
    assert bleu == pytest.approx({1: 0.75, 2: 0.0, 3: 0.0, 4: 2 / 3})


def test_scores(spark):
    df = frame(spark, [("s", 1), ("s", None), ("t", 4)], "system string, score int")
    out = {r.system: r for r in scoring.summary(df, "system").collect()}
    assert (out["s"].n, out["s"].stdev, out["s"].n_1, out["s"].n_4) == (1, 0.0, 1, 0)
    adv = scoring.group_advantage(frame(spark, [("p", 1.0), ("p", 3.0), ("q", 5.0)], "g string, r double"), "g", "r").collect()
    assert sorted(round(r.group_advantage, 3) for r in adv) == [-0.707, 0.0, 0.707]
    best = scoring.best_and_worst(frame(spark, [("p", 1.0, 1), ("p", 1.0, 2), ("p", 0.0, 3), ("p", 0.0, 4)], "g string, r double, i int"), "g", "r", "i", "i").first()
    assert (best.best.i, best.worst.i) == (2, 3)  # the ends of a stable sort: the last best, the first worst


def test_vocabulary(spark):
    df = frame(spark, [(1, "The cat, sat"), (2, ""), (3, None)], "id int, t string")
    v = frame(spark, [("the",), ("cat",)], "word string")
    got = {r.id: (r.n_tokens, r.n_out, r.inside_rate) for r in vocabulary.violations(df, "id", "t", v).collect()}
    assert got == {1: (4, 1, 0.75), 2: (0, 0, 1.0), 3: (0, 0, 1.0)}
    ids = {r.token: r.id for r in vocabulary.with_ids(v).collect()}
    assert ids["<PAD>"] == 0 and ids["cat"] == 27 and ids["the"] == 28


def test_puzzles(spark):
    df = frame(spark, [("a is on", "b is lit", "a is off", "b is dark", "c rings")], "p string, q string, not_p string, not_q string, r string")
    for rule, last, ok in (("modus_tollens", "A is off.", True), ("affirming_consequent", "A is on.", False), ("hypothetical_syllogism", "If a is on, then c rings.", True)):
        row = selecting.puzzles(df, F.lit(rule)).first()
        assert (row.conclusion, row.is_valid) == (last, ok)


def test_sources(spark, tmp_path):
    from pyspark.sql import types as T

    s = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"id": \n{"id": 2}\n')
    good, bad = jsonl.lenient(spark, str(tmp_path / "a.jsonl"), s)
    assert good.count() == 2 and bad.first().n_malformed == 1
    assert jsonl.records(spark, str(tmp_path / "none.jsonl"), s, True).count() == 0
    (tmp_path / "m.json").write_text('{"a": {"s": 1}, "b": {"s": 2}}')
    assert {tuple(r) for r in jsonl.object_map(spark, str(tmp_path / "m.json"), "struct<s: int>").collect()} == {("a", 1), ("b", 2)}
    man = sinks.write_batches(spark.range(5), str(tmp_path / "out"), "L", 2, "id").orderBy("batch").collect()
    assert [r.n_items for r in man] == [2, 2, 1]
    assert sinks.markdown(spark.range(2), ["id"]) == "| id |\n|---|\n| 0 |\n| 1 |"


def test_client_helpers():
    b = pipelines.Bucket(60, 2)
    assert [b.wait(0.0), b.wait(0.0), b.wait(0.0)] == [0.0, 0.0, 1.0]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert pipelines.retried(flaky, (TimeoutError,)) == "ok" and len(calls) == 3
    with pytest.raises(KeyError):
        pipelines.retried(lambda: {}[1], (TimeoutError,))


def test_losses_of_all_events(spark, data):
    from textquarry.plans.catalogue import QUERIES
    from textquarry.session import read_table

    values = {r.event_id: r.value for r in read_table(spark, data, "events").collect()}
    got = {r.event_id: r for r in QUERIES["x02_x03_all_losses"](spark, data).collect()}
    assert set(got) == set(values) and sum(v >= 30 for v in values.values()) > 0
    soft = lambda z: math.log1p(math.exp(-z))
    for k, v in values.items():
        assert got[k].ppl == pytest.approx(math.exp(min(v, 30)), rel=1e-12)
        assert got[k].dpo == pytest.approx(soft(0.1 * (v / 100 - 1)), abs=1e-6) and got[k].apo == pytest.approx(soft(0.1 * v / 100) + soft(-0.1), abs=1e-6)
    kept = {r.event_id: r for r in QUERIES["x02_x03_losses"](spark, data).collect()}
    assert set(kept) == {k for k, v in values.items() if v < 20} and all((r.dpo, r.apo) == (got[k].dpo, got[k].apo) for k, r in kept.items())


def test_vocabulary_in_batches_equals_the_join(spark):
    rows = [(1, "The Cat sat.", "A dog\u2019s bone"), (2, None, ""), (3, "cat cat THE 7 \n zebra", "x"), (4, "cat " * 5000, None)]
    df = frame(spark, rows, "id long, t string, u string")
    v = frame(spark, [("cat",), ("the",), ("dog's",)], "word string")
    key = lambda rs: sorted((r.id, r.n_tokens, tuple(r.violations)) for r in rs)
    small, large = (vocabulary.validated(df, "id", ["t", "u"], v, most=m).collect() for m in (100, 1))
    assert key(small) == key(large) and key(small)[0] == (1, 7, ("sat", "A", "bone"))
    tokens_of = vocabulary.with_ids(v)
    for pieces, name in ((False, "ids"), (True, "pieces")):
        a, b = (sorted((r.id, tuple(r[name])) for r in vocabulary.encoded(df, "id", "t", tokens_of, pieces=pieces, most=m).collect()) for m in (100, 1))
        assert a == b
    assert vocabulary.validated(df.limit(0), "id", ["t"], v).count() == 0


def test_preference_pairs(spark):
    rows = [("p", 1, "worst", 0.1, "x"), ("p", 2, "also worst", 0.1, "x"), ("p", 3, "good", 0.9, "ok"), ("q", 4, " same ", 0.1, "x"), ("q", 5, "same", 0.9, "ok"), ("r", 6, "only", 0.5, "ok")]
    df = frame(spark, rows, "prompt_id string, rollout_id long, text string, reward double, reason string")
    refs = frame(spark, [("p", "reference"), ("r", "only\n")], "prompt_id string, reference string")
    got = {(r.prompt_id, r.chosen, r.rejected, r.chosen_src) for r in scoring.preference_pairs(df, refs, "prompt_id", "text", "rollout_id").collect()}
    assert got == {("p", "reference", "worst", "p4"), ("p", "good", "worst", "onpolicy_best")}


def test_pairwise_and_profiles(spark):
    df = frame(spark, [("A", "x", "y"), ("", "x", "y"), (None, "x", "y"), ("tie", "x", "y"), ("?", "x", "y")], "winner string, slot_a string, slot_b string")
    assert {r.won: r.n for r in scoring.pairwise(df).collect()} == {"x": 1, "tie": 3, None: 1}
    few = scoring.length_profile(frame(spark, [("g", k) for k in (1, 2, 3)], "g string, k long"), "k", "g").first()
    assert (few.p10, few.p90, few.median, few.least, few.most) == (1, 3, 2, 1, 3)
    many = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7]
    got = scoring.length_profile(frame(spark, [("g", k) for k in many], "g string, k long"), "k", "g").first()
    cuts = statistics.quantiles(many, n=10)
    assert (got.p10, got.p90, got.median, got.at_90) == (pytest.approx(cuts[0]), pytest.approx(cuts[8]), statistics.median(many), sorted(many)[int(0.9 * len(many))])


def test_turns_and_sections(spark):
    df = frame(spark, [(1, "before\nMENO: One\n\n two \nANYTUS: Three"), (2, None), (3, ""), (4, "no speaker")], "id long, t string")
    got = [(r.id, r.turn, r.speaker, r.text) for r in chunking.turns(df, "id", "t", r"^([A-Z][A-Z]+):\s").orderBy("id", "turn").collect()]
    assert got == [(1, 1, "MENO", "One two"), (1, 2, "ANYTUS", "Three")]
    df = frame(spark, [(1, "# A\nx\ny\n# B"), (2, None)], "id long, t string")
    got = [(r.section, r.title, r.body, r.n_lines) for r in chunking.sections(df, "id", "t", r"^# ").orderBy("section").collect()]
    assert got == [(1, "# A", "x\ny", 2), (2, "# B", "", 0)]
