"""Queries over scores, runs and judgements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import text
from textquarry.functions.keys import seeded
from textquarry.operators import dedup, numbering, scoring, selecting, vocabulary
from textquarry.plans.registry import Registry
from textquarry.session import read_table
from textquarry.streaming import pipelines

R = Registry()
DIMS = ("engagement", "coherence", "substance", "expressive_adequacy")
SCORES = """scores AS (SELECT rollout_id, coalesce(policy, 'none') AS system, track AS bench, u.dim, u.score FROM rl_rollouts, LATERAL (SELECT unnest(['engagement', 'coherence', 'substance', 'expressive_adequacy']) AS dim, unnest([rollout_id % 5, (rollout_id // 3) % 5, CASE WHEN reward IS NULL THEN NULL ELSE least(4, floor(reward * 5))::BIGINT END, step % 6 - 1]) AS score) u)"""
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def _scores(spark, d):
    """A long table of scores made of the rollouts: system, bench, dim, score."""
    t = read_table(spark, d, "rl_rollouts")
    r = F.col("rollout_id")
    cols = {"engagement": F.pmod(r, F.lit(5)), "coherence": F.pmod(F.floor(r / 3), F.lit(5)), "substance": F.when(F.col("reward").isNotNull(), F.least(F.lit(4), F.floor(F.col("reward") * 5))), "expressive_adequacy": F.pmod(F.col("step"), F.lit(6)) - 1}
    wide = t.select("rollout_id", F.coalesce("policy", F.lit("none")).alias("system"), F.col("track").alias("bench"), *[c.cast("long").alias(k) for k, c in cols.items()])
    return wide.unpivot(["rollout_id", "system", "bench"], list(DIMS), "dim", "score")


@R.query(f"WITH {SCORES} SELECT bench, system, dim, count(score)::BIGINT AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS stdev, count(*) FILTER (score = 0)::BIGINT AS n_0, count(*) FILTER (score = 1)::BIGINT AS n_1, count(*) FILTER (score = 2)::BIGINT AS n_2, count(*) FILTER (score = 3)::BIGINT AS n_3, count(*) FILTER (score = 4)::BIGINT AS n_4 FROM scores GROUP BY 1, 2, 3")
def a01_a02_a03_summary(spark, d):
    """A1, A2, A3: means, deviations and zero-filled histograms."""
    return scoring.summary(_scores(spark, d), "bench", "system", "dim").withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@R.query(f"WITH {SCORES} SELECT dim, score, count(*)::BIGINT AS n FROM scores WHERE score IS NOT NULL GROUP BY 1, 2")
def a04_distribution(spark, d):
    """A4: a sparse distribution."""
    return _scores(spark, d).where("score is not null").groupBy("dim", "score").agg(F.count("*").alias("n"))


@R.query(f"WITH {SCORES} SELECT system, dim, bench, count(score)::BIGINT AS n, round(avg(score), 6) AS mean, grouping(bench)::INTEGER AS is_total FROM scores GROUP BY GROUPING SETS ((system, dim), (system, dim, bench))")
def a05_two_levels(spark, d):
    """A5: totals and types in one pass."""
    return scoring.two_levels(_scores(spark, d), ["system", "dim"], "bench").withColumn("mean", F.round("mean", 6))


@R.query(f"WITH {SCORES} SELECT bench, dim, round(avg(score) FILTER (system = 'grpo_a'), 6) AS mean_a, round(avg(score) FILTER (system = 'grpo_b'), 6) AS mean_b, round(avg(score) FILTER (system = 'grpo_b') - avg(score) FILTER (system = 'grpo_a'), 6) AS delta FROM scores GROUP BY 1, 2")
def a06_delta(spark, d):
    """Two systems side by side."""
    out = scoring.delta(_scores(spark, d), ["bench", "dim"], "system", "grpo_a", "grpo_b")
    return out.select("bench", "dim", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")])


@R.query(f"WITH {SCORES}, m AS (SELECT system, dim, avg(score) AS mean FROM scores GROUP BY 1, 2) SELECT x.dim, x.system AS a, y.system AS b, round(x.mean - y.mean, 6) AS delta FROM m x JOIN m y ON x.dim = y.dim AND x.system < y.system")
def a07_all_deltas(spark, d):
    """Every pair of systems."""
    means = _scores(spark, d).groupBy("system", "dim").agg(F.avg("score").alias("mean"))
    return scoring.all_deltas(means, ["dim"], "system", "mean").withColumn("delta", F.round("delta", 6))


@R.query(f"WITH {SCORES}, x AS (SELECT bench, dim, avg(score) FILTER (system = 'grpo_b') - avg(score) FILTER (system = 'grpo_a') AS delta, avg(score) FILTER (system = 'grpo_b') AS level FROM scores GROUP BY 1, 2) SELECT dim, round(avg(delta), 6) AS mean_delta, CASE WHEN avg(delta) > 0.05 THEN 'ahead' WHEN avg(delta) > -0.05 THEN 'parity' ELSE 'behind' END AS verdict, CASE WHEN min(level) >= 1.0 THEN 'pass' ELSE 'fail' END AS level FROM x GROUP BY 1")
def a08_a09_verdicts(spark, d):
    """The verdict on mean deltas, and a level to pass."""
    x = scoring.delta(_scores(spark, d), ["bench", "dim"], "system", "grpo_a", "grpo_b")
    return x.groupBy("dim").agg(F.avg("delta").alias("m"), F.min("mean_b").alias("l")).select("dim", F.round("m", 6).alias("mean_delta"), scoring.verdict(F.col("m")).alias("verdict"), scoring.against_threshold(F.col("l"), 1.0).alias("level"))


@R.query("SELECT run_label, count(*)::BIGINT AS n, round(avg(parse_ok::INT), 4) AS parse_rate, count(*) FILTER (failure_mode = 'no_marker')::BIGINT AS no_marker, count(*) FILTER (failure_mode = 'multiple_markers')::BIGINT AS multiple_markers, count(*) FILTER (failure_mode = 'empty_answer')::BIGINT AS empty_answer FROM bench_run GROUP BY 1")
def a10_a20_parse_rates(spark, d):
    """Rates of a flag, failure modes zero-filled."""
    t = read_table(spark, d, "bench_run")
    modes = [F.count(F.when(F.col("failure_mode") == m, 1)).alias(m) for m in ("no_marker", "multiple_markers", "empty_answer")]
    return t.groupBy("run_label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("parse_ok").cast("int")), 4).alias("parse_rate"), *modes)


PAIRS = "v AS (SELECT rollout_id, ['a', 'B', 'tie', 'x', '', NULL][rollout_id % 6 + 1] AS winner, CASE WHEN rollout_id % 2 = 0 THEN 'p4' ELSE 'p5' END AS slot_a, CASE WHEN rollout_id % 2 = 0 THEN 'p5' ELSE 'p4' END AS slot_b FROM rl_rollouts)"


@R.query(f"WITH {PAIRS} SELECT CASE WHEN upper(winner) = 'A' THEN slot_a WHEN upper(winner) = 'B' THEN slot_b WHEN upper(coalesce(winner, '')) IN ('TIE', '') THEN 'tie' END AS won, count(*)::BIGINT AS n FROM v GROUP BY 1")
def a11_pairwise(spark, d):
    """Wins with the slots undone; unknown winners count in no condition."""
    k = F.pmod("rollout_id", F.lit(6)).cast("int")
    even = F.col("rollout_id") % 2 == 0
    t = read_table(spark, d, "rl_rollouts").select(F.col("rollout_id").alias("id"), F.get(F.array(*[F.lit(x) for x in ("a", "B", "tie", "x", "", None)]), k).alias("winner"), F.when(even, "p4").otherwise("p5").alias("slot_a"), F.when(even, "p5").otherwise("p4").alias("slot_b"))
    return scoring.pairwise(t)


@R.query(f"WITH {SCORES} SELECT system, round(avg(CASE WHEN NOT (dim = 'expressive_adequacy' AND score = -1) THEN score END), 6) AS mean, round(avg(score) FILTER (dim = 'expressive_adequacy'), 6) AS raw FROM scores GROUP BY 1")
def a12_sentinel(spark, d):
    """Means without the sentinel of one dimension."""
    return _scores(spark, d).groupBy("system").agg(F.round(scoring.without_sentinel("score", "dim", "expressive_adequacy"), 6).alias("mean"), F.round(F.avg(F.when(F.col("dim") == "expressive_adequacy", F.col("score"))), 6).alias("raw"))


@R.query("SELECT id, count(latency_s)::BIGINT AS n, round(avg(latency_s), 6) AS mean, round(median(latency_s), 6) AS median, round(coalesce(stddev_samp(latency_s), 0), 6) AS stdev, min(latency_s) AS least, max(latency_s) AS most FROM bench_run GROUP BY 1")
def a13_described(spark, d):
    """Descriptive statistics."""
    return scoring.described(read_table(spark, d, "bench_run"), "latency_s", "id").select("id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")], "least", "most")


LENGTHS = f"""w AS (SELECT model, k FROM (SELECT coalesce(comparator_model, 'none') AS model, {WORDS.format('ugf_response')}::DOUBLE AS k FROM comparator_holdout WHERE ugf_response IS NOT NULL UNION ALL SELECT 'item ' || id, {WORDS.format('ugf_response')} FROM comparator_holdout WHERE ugf_response IS NOT NULL AND comparator_model = 'sunde-70b')),
s AS (SELECT model, list_sort(list(k)) AS a, avg(k) AS mean, median(k) AS median FROM w GROUP BY 1), j AS (SELECT *, len(a) AS n, greatest(1, least(len(a) - 1, (len(a) + 1) // 10)) AS j1, greatest(1, least(len(a) - 1, 9 * (len(a) + 1) // 10)) AS j9 FROM s)"""


@R.query(f"""WITH {LENGTHS} SELECT model, n::BIGINT AS n, round(mean, 6) AS mean, trunc(median)::BIGINT AS median, a[1]::BIGINT AS least, a[n]::BIGINT AS most,
CASE WHEN n < 10 THEN a[1] ELSE round((a[j1] * (10 - (n + 1 - 10 * j1)) + a[j1 + 1] * (n + 1 - 10 * j1)) / 10.0, 6) END::DOUBLE AS p10, CASE WHEN n < 10 THEN a[n] ELSE round((a[j9] * (10 - (9 * (n + 1) - 10 * j9)) + a[j9 + 1] * (9 * (n + 1) - 10 * j9)) / 10.0, 6) END::DOUBLE AS p90, a[least(floor(n * 0.9)::BIGINT, n - 1) + 1]::BIGINT AS at_90 FROM j""")
def a14_a15_length_profile(spark, d):
    """Whole medians, ends, exclusive deciles (the ends below ten values) and the value at nine
    tenths, of models and of single items, which have few values."""
    t = read_table(spark, d, "comparator_holdout").where("ugf_response is not null").withColumn("k", text.word_count("ugf_response").cast("long"))
    models = t.select(F.coalesce("comparator_model", F.lit("none")).alias("model"), "k")
    items = t.where("comparator_model = 'sunde-70b'").select(F.concat(F.lit("item "), "id").alias("model"), "k")
    whole = [F.floor(c).cast("long").alias(c) for c in ("median", "least", "most")]
    return scoring.length_profile(models.unionAll(items), "k", "model").select("model", "n", F.round("mean", 6).alias("mean"), *whole, F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"), F.col("at_90").cast("long").alias("at_90"))


DIM_SCORES = "p AS (SELECT CASE WHEN rollout_id % 2 = 0 THEN 'p4' ELSE 'p5' END AS slot_a, CASE WHEN rollout_id % 2 = 0 THEN 'p5' ELSE 'p4' END AS slot_b, u.dim, u.a, u.b FROM rl_rollouts, LATERAL (SELECT unnest(['engagement', 'coherence']) AS dim, unnest([rollout_id % 5, CASE WHEN reward IS NULL THEN NULL ELSE floor(reward * 4)::BIGINT END]) AS a, unnest([step % 5, step % 3]) AS b) u)"


@R.query(f"WITH {DIM_SCORES} SELECT dim, CASE WHEN a > b THEN slot_a WHEN b > a THEN slot_b ELSE 'tie' END AS won, count(*)::BIGINT AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def a11_pairwise_dimensions(spark, d):
    """Wins in each dimension."""
    even = F.col("rollout_id") % 2 == 0
    a = F.struct(F.pmod("rollout_id", F.lit(5)).alias("engagement"), F.floor(F.col("reward") * 4).alias("coherence"))
    b = F.struct((F.col("step") % 5).cast("long").alias("engagement"), (F.col("step") % 3).cast("long").alias("coherence"))
    t = read_table(spark, d, "rl_rollouts").select(F.when(even, "p4").otherwise("p5").alias("slot_a"), F.when(even, "p5").otherwise("p4").alias("slot_b"), a.alias("scores_a"), b.alias("scores_b"))
    return scoring.pairwise_dims(t, ("engagement", "coherence"))


@R.query("""WITH t AS (SELECT prompt_id, rollout_id, completion_text AS text, reward, CASE WHEN reward > 0.5 THEN 'ok' ELSE reason END AS reason FROM rl_rollouts WHERE reward IS NOT NULL AND completion_text IS NOT NULL),
e AS (SELECT prompt_id, arg_max(text, (reward, rollout_id)) AS best, arg_min(text, (reward, rollout_id)) AS worst, max(reward) AS high, min(reward) AS low, arg_max(coalesce(reason, ''), (reward, rollout_id)) AS reason FROM t GROUP BY 1),
r AS (SELECT id AS prompt_id, min(ugf_response) AS reference FROM comparator_holdout WHERE ugf_response <> '' GROUP BY 1), j AS (SELECT * FROM e LEFT JOIN r USING (prompt_id))
SELECT prompt_id, md5(reference) AS chosen, md5(worst) AS rejected, 'p4' AS chosen_src, 1.0::DOUBLE AS chosen_score, round(low, 4) AS rejected_score FROM j WHERE reference IS NOT NULL AND worst <> '' AND trim(reference) <> trim(worst)
UNION ALL SELECT prompt_id, md5(best), md5(worst), 'onpolicy_best', round(high, 4), round(low, 4) FROM j WHERE reason = 'ok' AND high - low >= 0.2 AND trim(best) <> trim(worst)""")
def w10_preference_pairs(spark, d):
    """W10, Q-seq5: the pairs of a preference corpus, reference or best against the worst."""
    t = read_table(spark, d, "rl_rollouts").where("reward is not null and completion_text is not null").withColumn("reason", F.when(F.col("reward") > 0.5, "ok").otherwise(F.col("reason")))
    refs = read_table(spark, d, "comparator_holdout").where("ugf_response <> ''").groupBy(F.col("id").alias("prompt_id")).agg(F.min("ugf_response").alias("reference"))
    out = scoring.preference_pairs(t, refs, "prompt_id", "completion_text", "rollout_id")
    return out.select("prompt_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "chosen_src", "chosen_score", "rejected_score")


@R.query(f"WITH w AS (SELECT b.type, CASE WHEN ugf_response IS NULL OR ugf_response = '' OR starts_with(ugf_response, '<') THEN 0 ELSE {WORDS.format('ugf_response')} END AS k FROM comparator_holdout JOIN bench b USING (id)) SELECT type, count(*)::BIGINT AS n, round(avg(k), 6) AS mean_words, round(avg((k < 20)::INT), 6) AS short_rate FROM w GROUP BY 1 ORDER BY mean_words DESC")
def a16_w16_short_rates(spark, d):
    """Short responses and mean words of each type, the wordiest first."""
    t = read_table(spark, d, "comparator_holdout").select("id", text.response_words("ugf_response").alias("k")).join(read_table(spark, d, "bench").select("id", "type"), "id")
    return t.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean_words"), F.round(F.avg((F.col("k") < 20).cast("int")), 6).alias("short_rate")).orderBy(F.desc("mean_words"))


@R.query("SELECT coalesce(reason, 'none') AS reason, count(*)::BIGINT AS n, round(avg(reward), 6) AS mean_reward, max(reward) AS max_reward, round(avg((reward > 0)::INT), 6) AS positive_rate FROM rl_rollouts GROUP BY 1")
def a19_reasons(spark, d):
    """Reasons and rewards."""
    return read_table(spark, d, "rl_rollouts").groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.max("reward").alias("max_reward"), F.round(F.avg((F.col("reward") > 0).cast("int")), 6).alias("positive_rate"))


@R.query("SELECT regexp_replace(run_label, '_[0-9]+_[0-9]+$', '') AS family, 500::BIGINT AS expected, count(*)::BIGINT AS received, count(DISTINCT id)::BIGINT AS scored FROM bench_run GROUP BY 1")
def a23_counts(spark, d):
    """Expected, received, and scored once."""
    n = read_table(spark, d, "bench").count()
    return read_table(spark, d, "bench_run").groupBy(F.regexp_replace("run_label", "_[0-9]+_[0-9]+$", "").alias("family")).agg(F.lit(n).cast("long").alias("expected"), F.count("*").alias("received"), F.countDistinct("id").alias("scored"))


@R.query("SELECT prompt_id, track AS dim, count(reward)::BIGINT AS n_valid, CASE WHEN count(reward) >= 2 THEN round(avg(reward), 9) END AS jury_mean FROM rl_rollouts GROUP BY 1, 2")
def a24_jury(spark, d):
    """A mean needs two valid scores."""
    t = read_table(spark, d, "rl_rollouts").select("prompt_id", F.col("track").alias("dim"), F.col("reward").alias("score"))
    return scoring.jury(t, "prompt_id", "dim").withColumn("jury_mean", F.round("jury_mean", 9))


@R.query(f"""WITH w AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(completion_text), '[a-zA-Z]+(?:''[a-zA-Z]+)*')) AS word FROM rl_rollouts) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 500),
o AS (SELECT rollout_id, count(*) FILTER (w.word IS NULL AND t.tok NOT IN ('.', ',', '!', '?', ';', ':', '-', '(', ')', '"', '''', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9', E'\\n')) AS n_out FROM (SELECT rollout_id, unnest(regexp_extract_all(completion_text, '[a-zA-Z]+(?:''[a-zA-Z]+)*|\\d|\\n|\\S')) AS tok FROM rl_rollouts) t LEFT JOIN w ON lower(t.tok) = w.word GROUP BY 1),
p AS (SELECT r.rollout_id, coalesce(o.n_out, 0) = 0 AS vocab_ok, len(regexp_extract_all(completion_text, '[Ss]o my answer is:')) AS n, nullif(regexp_replace(regexp_extract(completion_text, '(?s)^(.*)[Ss]o my answer is:(.*)$', 2), '^\\s+|\\s+$', '', 'g'), '') AS answer, list_filter(regexp_split_to_array(completion_text, '\\s+'), lambda w: w <> '') AS k, reward FROM rl_rollouts r LEFT JOIN o USING (rollout_id) WHERE completion_text IS NOT NULL)
SELECT rollout_id, CASE WHEN NOT vocab_ok THEN 'vocab_fail' WHEN n <> 1 OR answer IS NULL THEN 'parse_fail' WHEN len(k) >= 12 AND len(list_filter(range(0, len(k) - 11), lambda p: k[p + 1:p + 8] = k[p + 5:p + 12])) > 0 THEN 'doom_loop' WHEN len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) < 3 THEN 'answer_too_short' WHEN reward IS NULL THEN 'judge_pending' ELSE 'ok' END AS gate FROM p""")
def f11_gates(spark, d):
    """the structural gates in their order."""
    t = read_table(spark, d, "rl_rollouts").where("completion_text is not null")
    vocab = vocabulary.top(vocabulary.frequencies(read_table(spark, d, "rl_rollouts"), "completion_text"), 500).select("word")
    ok = vocabulary.violations(t, "rollout_id", "completion_text", vocab).select("rollout_id", (F.col("n_out") == 0).alias("vocab_ok"))
    p = text.answer_parts("completion_text")
    gate = selecting.structural_gate(F.col("vocab_ok"), p["parse_ok"], text.has_loop("completion_text"), text.word_count(p["answer"]), F.col("reward").isNotNull())
    return t.join(ok, "rollout_id").select("rollout_id", gate.alias("gate"))


@R.query("SELECT rollout_id, round((0.6 * (rollout_id % 5) + 0.2 * ((rollout_id // 3) % 5) + 0.1 * ((rollout_id // 7) % 5) + 0.1 * ((rollout_id // 11) % 5)) / 4.0, 4)::DOUBLE AS weighted FROM rl_rollouts")
def a25_weighted_reward(spark, d):
    """The weighted reward."""
    part = lambda k: F.pmod(F.floor(F.col("rollout_id") / k), F.lit(5)).cast("double")
    return read_table(spark, d, "rl_rollouts").select("rollout_id", selecting.weighted_reward(part(1), part(3), part(7), part(11)).alias("weighted"))


@R.query("SELECT form, teacher, count(*)::BIGINT AS n, count(*) FILTER (compliant)::BIGINT AS n_ok, round(avg(len(remaining_violations)), 6) AS mean_violations FROM ugf_forms_corpus GROUP BY 1, 2")
def a28_a29_compliance(spark, d):
    """Compliance and violations by form and teacher."""
    t = read_table(spark, d, "ugf_forms_corpus")
    return t.groupBy("form", "teacher").agg(F.count("*").alias("n"), F.count(F.when(F.col("compliant"), 1)).alias("n_ok"), F.round(F.avg(F.when(F.col("remaining_violations").isNotNull(), F.size("remaining_violations"))), 6).alias("mean_violations"))


@R.query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value) / count(*), 6) AS mean_loss, round(exp(least(sum(value) / count(*) / 10, 30)), 3) AS ppl FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 100 GROUP BY 1")
def a30_source_losses(spark, d):
    """The loss of each source over its first hundred batches."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = read_table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 100")
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.count("*"), 6).alias("mean_loss"), F.round(F.exp(F.least(F.sum("value") / F.count("*") / 10, F.lit(30.0))), 3).alias("ppl"))


@R.query("SELECT form, count(*)::BIGINT AS n, round(avg((len(v) = 0)::INT), 6) AS strict_rate, round(avg((len(list_filter(v, lambda w: NOT (regexp_matches(w, '^[A-Z]') AND lower(w) IN ('thus', 'plato')))) = 0)::INT), 6) AS adjusted_rate, round(avg(len(list_filter(v, lambda w: NOT regexp_matches(w, '^[A-Z]')))), 6) AS mean_lexical FROM (SELECT form, list_transform(remaining_violations, lambda w: CASE WHEN length(w) % 2 = 0 THEN upper(w[1]) || w[2:] ELSE w END) AS v FROM ugf_forms_corpus WHERE remaining_violations IS NOT NULL) GROUP BY 1")
def a29_strict_adjusted(spark, d):
    """Strict and adjusted compliance and the mean of lexical violations."""
    v = F.transform("remaining_violations", lambda w: F.when(F.length(w) % 2 == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))).otherwise(w))
    out = scoring.compliance_rates(read_table(spark, d, "ugf_forms_corpus").withColumn("v", v), "v", ["thus", "plato"], "form")
    return out.select("form", "n", *[F.round(c, 6).alias(c) for c in ("strict_rate", "adjusted_rate", "mean_lexical")])


@R.query("WITH g AS (SELECT form, count(*) AS n, sum(len(response)) / 1000.0 / count(*) AS loss FROM ugf_forms_corpus WHERE response IS NOT NULL GROUP BY 1) SELECT round(sum(loss * n) / sum(n), 6) AS overall_loss, round(exp(least(sum(loss * n) / sum(n), 30)), 4) AS overall_ppl FROM g")
def a30_overall_loss(spark, d):
    """The overall loss, the sources weighted by their batches."""
    t = read_table(spark, d, "ugf_forms_corpus").where("response is not null")
    g = t.groupBy("form").agg(F.count("*").alias("n_batches"), (F.sum(F.length("response")) / 1000.0 / F.count("*")).alias("loss"))
    return scoring.overall_loss(g).select(F.round("overall_loss", 6).alias("overall_loss"), F.round("overall_ppl", 4).alias("overall_ppl"))


@R.query("SELECT rollout_id, round((reward - avg(reward) OVER (PARTITION BY prompt_id)) / (coalesce(stddev_samp(reward) OVER (PARTITION BY prompt_id), 0) + 0.000001), 4) AS group_advantage FROM rl_rollouts WHERE reward IS NOT NULL")
def w09_group_advantage(spark, d):
    """Advantages within a prompt; one prompt holds a tenth of the rows."""
    t = read_table(spark, d, "rl_rollouts").where("reward is not null").select("rollout_id", "prompt_id", "reward")
    return scoring.group_advantage(t, "prompt_id", "reward").select("rollout_id", F.round("group_advantage", 4).alias("group_advantage"))


@R.query("SELECT prompt_id, count(*)::BIGINT AS n, arg_max(rollout_id, (reward, rollout_id)) AS best_id, max(reward) AS best_reward, arg_min(rollout_id, (reward, rollout_id)) AS worst_id, min(reward) AS worst_reward FROM rl_rollouts WHERE reward IS NOT NULL GROUP BY 1")
def w10_best_and_worst(spark, d):
    """The last best and the first worst rollout, the ends of a stable sort."""
    t = read_table(spark, d, "rl_rollouts").where("reward is not null")
    return scoring.best_and_worst(t, "prompt_id", "reward", "rollout_id", "rollout_id", "reward").select("prompt_id", "n", F.col("best.rollout_id").alias("best_id"), F.col("best.reward").alias("best_reward"), F.col("worst.rollout_id").alias("worst_id"), F.col("worst.reward").alias("worst_reward"))


@R.query("SELECT user_id, event_id, n = 50 AND t > 50 AS halt FROM (SELECT user_id, event_id, avg(value) OVER w AS t, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))")
def w11_halting(spark, d):
    """The trailing rule of each run."""
    return scoring.halted(read_table(spark, d, "events"), "event_id", "value", 50, 50.0, "user_id").select("user_id", "event_id", "halt")


@R.query("SELECT rec_id, comparator_latency_s FROM comparator_holdout WHERE comparator_latency_s IS NOT NULL ORDER BY comparator_latency_s DESC, rec_id LIMIT 3")
def w15_three_worst(spark, d):
    """The three worst."""
    return read_table(spark, d, "comparator_holdout").where("comparator_latency_s is not null").orderBy(F.desc("comparator_latency_s"), "rec_id").limit(3).select("rec_id", "comparator_latency_s")


@R.query(f"SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY ({WORDS.format('question')} >= 40), id) AS k FROM bench) WHERE k = 1")
def w17_first_of_type(spark, d):
    """The first item of each type, short ones before long."""
    b = read_table(spark, d, "bench").select("type", "id", (text.word_count("question") >= 40).alias("long"))
    return dedup.first_by(b, ["type"], "long", "id").select("type", "id")


@R.query("""WITH u AS (SELECT 'run' AS system, id, rec_id FROM bench_run WHERE ugf_response <> '' AND NOT starts_with(ltrim(ugf_response), '<') UNION ALL SELECT 'comparator', id, rec_id FROM comparator_holdout WHERE ugf_response <> '' AND NOT starts_with(ltrim(ugf_response), '<')), k AS (SELECT *, md5('1|' || id || '|' || system || '|' || rec_id) AS h FROM u), n AS (SELECT *, row_number() OVER (ORDER BY h, system, rec_id) AS rn FROM k)
SELECT system, rec_id, 'item-' || lpad(rn::VARCHAR, 6, '0') AS opaque_id, ((rn - 1) // 30 + 1)::BIGINT AS batch, ((rn - 1) % 30 + 1)::BIGINT AS place FROM n""")
def w05_m09_blinded(spark, d):
    """Two systems blinded into numbered batches of thirty."""
    side = lambda t, s: read_table(spark, d, t).where(text.usable("ugf_response")).select(F.lit(s).alias("system"), "id", "rec_id")
    u = side("bench_run", "run").unionAll(side("comparator_holdout", "comparator")).withColumn("h", seeded(1, "id", "system", "rec_id"))
    out = numbering.opaque(numbering.batches(u, "h", "system", "rec_id", size=30), "item")
    return out.select("system", "rec_id", "opaque_id", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


@R.query("SELECT rec_id, ntile(12) OVER (ORDER BY md5('2|' || rec_id), rec_id)::BIGINT AS part FROM comparator_holdout")
def w06_near_equal(spark, d):
    """Twelve parts of near equal size."""
    t = read_table(spark, d, "comparator_holdout").select("rec_id", seeded(2, "rec_id").alias("h"))
    return numbering.near_equal(t, "h", "rec_id", parts=12).select("rec_id", "part")


@R.query("SELECT 'audit' AS label, ((k - 1) // 40 + 1)::BIGINT AS batch, count(*)::BIGINT AS n_items FROM (SELECT row_number() OVER (ORDER BY rec_id) AS k FROM comparator_holdout) GROUP BY 2 UNION ALL SELECT 'kept', 1, 7")
def k02_k03_manifest(spark, d):
    """K2, K3: the manifest of a batched sink, merged into another."""
    from textquarry.sources.sinks import manifest

    b = numbering.batches(read_table(spark, d, "comparator_holdout").select("rec_id"), "rec_id", size=40)
    fresh = manifest(b, "audit", "out").select("label", F.col("batch").cast("long").alias("batch"), "n_items")
    old = spark.createDataFrame([("audit", 1, 3), ("kept", 1, 7)], "label string, batch long, n_items long")
    return dedup.merged_manifest(old, fresh, "audit")


@R.query("""WITH t AS (SELECT 'item-' || lpad((row_number() OVER (ORDER BY id))::VARCHAR, 6, '0') AS opaque_id, id, type FROM bench), s AS (SELECT rollout_id, 'item-' || lpad((rollout_id % 700 + 1)::VARCHAR, 6, '0') AS opaque_id, reward FROM rl_rollouts) SELECT coalesce(type, 'unknown id') AS type, count(*)::BIGINT AS n, round(avg(reward), 6) AS mean_reward FROM s LEFT JOIN t USING (opaque_id) GROUP BY 1""")
def j04_joined_truth(spark, d):
    """Scores joined to what their ids stand for; unknown ids counted apart."""
    truth = numbering.opaque(numbering.numbered(read_table(spark, d, "bench").select("id", "type"), "id"), "item").select("opaque_id", "type")
    s = read_table(spark, d, "rl_rollouts").select((F.pmod("rollout_id", F.lit(700)) + 1).alias("rn"), "reward")
    s = numbering.opaque(s, "item")
    known, _ = scoring.joined_truth(s, truth)
    unknown = s.join(truth.select("opaque_id"), "opaque_id", "left_anti").agg(F.lit("unknown id").alias("type"), F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"))
    return known.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward")).unionAll(unknown.where("n > 0"))


@R.query("WITH a AS (SELECT id, rec_id, row_number() OVER (PARTITION BY id ORDER BY rec_id) AS attempt, coalesce(parse_ok, false) AS compliant FROM bench_run), b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY compliant DESC, CASE WHEN compliant THEN attempt ELSE -attempt END) AS k FROM a) SELECT id, rec_id, attempt::BIGINT AS attempt, compliant, n::BIGINT AS n_attempts FROM b WHERE k = 1")
def z07_settled(spark, d):
    """The outcome of a validate-and-retry loop."""
    a = read_table(spark, d, "bench_run").select("id", "rec_id", F.coalesce("parse_ok", F.lit(False)).alias("compliant"))
    best = pipelines.settled(a, order="rec_id")
    before = a.join(best.select("id", F.col("rec_id").alias("_at")), "id").where(F.col("rec_id") <= F.col("_at")).groupBy("id").agg(F.count("*").alias("attempt"))
    return best.join(before, "id")


@R.query("SELECT b.id, r.rec_id, r.rec_id IS NULL AS failed, CASE WHEN r.rec_id IS NULL THEN 'no result' END AS failure_reason FROM bench b LEFT JOIN (SELECT id, min(rec_id) AS rec_id FROM comparator_holdout WHERE comparator_model = 'oster-7b' GROUP BY 1) r USING (id)")
def z08_closed(spark, d):
    """A failure record for what has no result."""
    r = read_table(spark, d, "comparator_holdout").where("comparator_model = 'oster-7b'").groupBy("id").agg(F.min("rec_id").alias("rec_id"))
    return pipelines.closed(read_table(spark, d, "bench").select("id"), r, "id")


@R.query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def grouped_line_items(spark, d):
    """Grouped aggregates over the largest table."""
    t = read_table(spark, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@R.query("SELECT c_mktsegment, o_orderstatus, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def joined_line_items(spark, d):
    """Two equi-joins under an aggregate."""
    li, o, c = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
