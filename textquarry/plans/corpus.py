"""Queries over the corpora: scans, filters, keys, joins, duplicates, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import keys, text
from textquarry.operators import dedup, numbering, sampling, selecting
from textquarry.plans.registry import Registry
from textquarry.session import read_table

R = Registry()
BUCKET = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % 10000)"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


@R.query(f"""
WITH d AS (SELECT *, coalesce(source, 'none') || '-' || doc_id AS id FROM documents),
r AS (SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text'
   WHEN {BUCKET.format("id")} < 500 THEN 'held_out'
   WHEN {WORDS.format("text")} < 10 THEN 'too_short'
   WHEN length(text) > 20000 THEN 'too_long' ELSE 'kept' END AS reason FROM d),
k AS (SELECT *, CASE WHEN reason = 'kept' AND row_number() OVER (PARTITION BY source, reason, substr(md5(trim(text)), 1, 12) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE reason END AS skip_reason FROM r)
SELECT coalesce(lang, 'none') AS lang, skip_reason, count(*)::BIGINT AS n FROM k GROUP BY 1, 2""")
def corpus_selection_report(spark, d):
    """Held-out-aware selection: stable split, filters with skip reasons, exact duplicates, composition."""
    docs = read_table(spark, d, "documents").withColumn("id", F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.col("doc_id")))
    reasons = [
        ("no_text", F.col("text").isNull() | (text.strip("text") == "")),
        ("held_out", keys.in_holdout("id", 0.05)),
        ("too_short", text.word_count("text") < 10),
        ("too_long", F.char_length("text") > 20000),
    ]
    flagged = selecting.with_skip_reason(docs, reasons).select("doc_id", "lang", "source", "skip_reason", keys.content_hash(F.col("text")).alias("h"))
    kept = flagged.where("skip_reason = 'kept'")
    firsts = kept.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"))
    dup = kept.select("doc_id").join(firsts.select("doc_id"), "doc_id", "left_anti").withColumn("dup", F.lit(True))
    final = flagged.join(dup, "doc_id", "left").withColumn("skip_reason", F.when(F.col("dup"), "duplicate").otherwise(F.col("skip_reason")))
    return final.groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), "skip_reason").agg(F.count("*").alias("n"))


@R.query("SELECT coalesce(content_type, 'none') AS content_type, count(*) FILTER (coalesce(compliant, true))::BIGINT AS n_lenient, count(*) FILTER (coalesce(compliant, false))::BIGINT AS n_strict FROM ugf_reasoning GROUP BY 1")
def f01_compliance(spark, d):
    """both readings of a missing flag."""
    t = read_table(spark, d, "ugf_reasoning")
    return t.groupBy(F.coalesce("content_type", F.lit("none")).alias("content_type")).agg(F.count(F.when(selecting.compliant(True), 1)).alias("n_lenient"), F.count(F.when(selecting.compliant(False), 1)).alias("n_strict"))


@R.query(f"SELECT rec_id, {WORDS.format('ugf_text')}::BIGINT AS n_words, length(ugf_text)::BIGINT AS n_chars FROM ugf_reasoning WHERE {WORDS.format('ugf_text')} >= 10 AND length(ugf_text) BETWEEN 80 AND 1200")
def f02_f03_lengths(spark, d):
    """Word floor and character band."""
    t = read_table(spark, d, "ugf_reasoning")
    return t.where((text.word_count("ugf_text") >= 10) & selecting.length_within("ugf_text", 80, 1200)).select("rec_id", text.word_count("ugf_text").cast("long").alias("n_words"), F.char_length("ugf_text").cast("long").alias("n_chars"))


@R.query("SELECT source, form, count(*)::BIGINT AS n FROM ugf_forms_corpus WHERE trim(coalesce(prompt, '')) <> '' AND trim(coalesce(response, '')) <> '' AND form IN ('essay', 'dialogue') AND starts_with(id, 'lamp') GROUP BY 1, 2")
def f05_f06_membership(spark, d):
    """filled fields, sets and prefixes."""
    t = read_table(spark, d, "ugf_forms_corpus")
    return t.where(selecting.filled("prompt") & selecting.filled("response") & F.col("form").isin("essay", "dialogue") & F.col("id").startswith("lamp")).groupBy("source", "form").agg(F.count("*").alias("n"))


@R.query("SELECT coalesce(track, 'none') AS track, count(*)::BIGINT AS n FROM ugf_cot WHERE track IS DISTINCT FROM 'logic' GROUP BY 1")
def f07_exclude_track(spark, d):
    """all but one track, nulls kept."""
    return read_table(spark, d, "ugf_cot").where(selecting.not_value("track", "logic")).groupBy(F.coalesce("track", F.lit("none")).alias("track")).agg(F.count("*").alias("n"))


@R.query("SELECT rec_id, (NOT starts_with(ugf_response, '<')) AS unstripped FROM comparator_holdout WHERE ugf_response <> '' AND NOT starts_with(ltrim(ugf_response), '<')")
def f08_usable(spark, d):
    """F8: usable responses."""
    return read_table(spark, d, "comparator_holdout").where(text.usable("ugf_response")).select("rec_id", text.usable("ugf_response", False).alias("unstripped"))


@R.query(f"""SELECT CASE WHEN NOT coalesce(compliant, true) THEN 'not_compliant' WHEN regexp_replace(id, '-[^-]*$', '') IN (SELECT DISTINCT regexp_replace(id, '-[^-]*$', '') FROM ugf_reasoning WHERE content_type = 'counter_case' AND {BUCKET.format("id")} < 10) THEN 'held_out' WHEN {BUCKET.format("id")} < 200 THEN 'hashed_out'
 WHEN coalesce(content_type, '') NOT IN ('open_dialogue', 'counter_case') THEN 'type' WHEN ugf_text IS NULL OR {WORDS.format("ugf_text")} < 10 THEN 'too_short' ELSE 'kept' END AS skip_reason, count(*)::BIGINT AS n FROM ugf_reasoning GROUP BY 1""")
def f09_skip_reasons(spark, d):
    """An ordered cascade, the first failing reason counted; document keys held out."""
    t = read_table(spark, d, "ugf_reasoning")
    held = t.where((F.col("content_type") == "counter_case") & (keys.bucket("id") < 10)).select(keys.doc_key("id").alias("doc")).distinct().withColumn("held", F.lit(True))
    j = t.withColumn("doc", keys.doc_key("id")).join(held, "doc", "left")
    out = selecting.with_skip_reason(j, [
        ("not_compliant", ~selecting.compliant(True)), ("held_out", F.col("held")), ("hashed_out", keys.in_holdout("id", 0.02)),
        ("type", ~F.coalesce("content_type", F.lit("")).isin("open_dialogue", "counter_case")), ("too_short", text.word_count("ugf_text") < 10),
    ])
    return out.groupBy("skip_reason").agg(F.count("*").alias("n"))


@R.query("SELECT CASE WHEN s >= 14 THEN 'high' WHEN s BETWEEN 8 AND 12 THEN 'mid' WHEN s <= 6 THEN 'low' END AS tier, count(*)::BIGINT AS n FROM (SELECT rollout_id % 5 + (rollout_id // 5) % 5 + (rollout_id // 25) % 5 + (rollout_id // 125) % 5 AS s FROM rl_rollouts) GROUP BY 1")
def f10_tiers(spark, d):
    """score bands."""
    r = F.col("rollout_id")
    s = sum((F.pmod(F.floor(r / 5**k), F.lit(5)) for k in range(1, 4)), F.pmod(r, F.lit(5)))
    return read_table(spark, d, "rl_rollouts").select(selecting.tiers(s).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@R.query(f"SELECT id, type FROM bench WHERE type = 'modal' AND contains(lower(question), 'the') AND {WORDS.format('question')} < 60")
def f12_report_filter(spark, d):
    """the filters of an interactive report."""
    return read_table(spark, d, "bench").where((F.col("type") == "modal") & F.lower("question").contains("the") & (text.word_count("question") < 60)).select("id", "type")


@R.query("""SELECT corpus, stratum, producer, count(*)::BIGINT AS n, sum(length(response))::BIGINT AS n_chars FROM (
SELECT 'reasoning' AS corpus, coalesce(content_type, 'unknown') AS stratum, source_model AS producer, ugf_text AS response FROM ugf_reasoning WHERE coalesce(compliant, false) AND ugf_text <> '' AND topic <> ''
UNION ALL SELECT 'forms', coalesce(form, 'unknown'), teacher, response FROM ugf_forms_corpus WHERE coalesce(compliant, false) AND prompt <> '' AND response <> ''
UNION ALL SELECT 'cot', coalesce(track, 'unknown') || '_' || coalesce(depth, 'unknown'), source_model, CASE WHEN coalesce(nullif(conclusion, ''), nullif(verdict, ''), '') <> '' THEN trim(reasoning || ' ' || coalesce(nullif(conclusion, ''), nullif(verdict, ''), '')) ELSE reasoning END FROM ugf_cot WHERE coalesce(compliant, false) AND reasoning <> '') GROUP BY 1, 2, 3""")
def p01_audit_union(spark, d):
    """Three corpora in one form through the registry of handlers."""
    tables = {"reasoning": read_table(spark, d, "ugf_reasoning"), "forms": read_table(spark, d, "ugf_forms_corpus"), "cot": read_table(spark, d, "ugf_cot")}
    return selecting.audited(tables).groupBy("corpus", "stratum", "producer").agg(F.count("*").alias("n"), F.sum(F.char_length("response")).alias("n_chars"))


@R.query("""SELECT id, field, trim(text) AS text FROM (SELECT id, 'instruction' AS field, instruction AS text FROM bench UNION ALL SELECT id, 'question', question FROM bench UNION ALL SELECT id, 'expected_answer', expected_answer FROM bench) WHERE length(trim(text)) >= 20""")
def p02_unpivot(spark, d):
    """One row for each text field."""
    return selecting.unpivoted(read_table(spark, d, "bench"), "id", ["instruction", "question", "expected_answer"])


@R.query("SELECT rec_id, replace('ref-' || source || '-' || id, '_', '-') AS new_id, regexp_replace(id, '-[^-]*$', '') AS doc, CASE WHEN coalesce(element_at(metadata, 'title')[1], '') <> '' THEN lower(element_at(metadata, 'title')[1]) WHEN coalesce(form, '') <> '' THEN form ELSE 'none' END AS topic FROM ugf_forms_corpus")
def p03_p04_ids_topics(spark, d):
    """Derived ids, document keys, topics with fallbacks."""
    title = F.nullif(F.col("metadata")["title"], F.lit(""))
    return read_table(spark, d, "ugf_forms_corpus").select("rec_id", F.replace(F.concat(F.lit("ref-"), "source", F.lit("-"), "id"), F.lit("_"), F.lit("-")).alias("new_id"), keys.doc_key("id").alias("doc"), F.coalesce(F.lower(title), F.nullif("form", F.lit("")), F.lit("none")).alias("topic"))


TEMPLATES = [("open_dialogue", "Two people speak of {topic}."), ("counter_case", "Find a case against {topic}."), ("argument_analysis", "Take apart: {topic}.")]


@R.query("""SELECT rec_id, replace(CASE content_type WHEN 'open_dialogue' THEN 'Two people speak of {topic}.' WHEN 'counter_case' THEN 'Find a case against {topic}.' ELSE 'Take apart: {topic}.' END, '{topic}', topic) AS rendered FROM ugf_reasoning""")
def p05_templates(spark, d):
    """Templates by a dimension join, with a default."""
    dim = spark.createDataFrame(TEMPLATES, "content_type string, template string")
    return selecting.rendered(read_table(spark, d, "ugf_reasoning"), dim, "content_type", "topic", "argument_analysis").select("rec_id", "rendered")


@R.query("SELECT id, CASE 'stress_' || type WHEN 'stress_modal' THEN 'concept_explanation' WHEN 'stress_deontic' THEN 'concept_explanation' WHEN 'stress_counterfactual' THEN 'concept_explanation' WHEN 'stress_supervenience' THEN 'concept_explanation' WHEN 'stress_use_mention' THEN 'concept_explanation' WHEN 'stress_intensional' THEN 'concept_explanation' WHEN 'stress_self_reference' THEN 'concept_explanation' WHEN 'stress_vagueness' THEN 'concept_explanation' WHEN 'stress_abstract' THEN 'concept_explanation' WHEN 'stress_phenomenal' THEN 'concept_explanation' ELSE 'argument_analysis' END AS template FROM bench")
def p06_template_names(spark, d):
    """The template of an item's type."""
    return read_table(spark, d, "bench").withColumn("t", F.concat(F.lit("stress_"), "type")).select("id", selecting.template_name("t").alias("template"))


@R.query("SELECT id, CASE WHEN trim(coalesce(instruction, '')) <> '' THEN instruction || E'\\n\\n' || question ELSE question END AS query, coalesce(instruction, '') || E'\\n\\n' || question AS always FROM bench")
def p07_t39_queries(spark, d):
    """The query of an item, in both forms."""
    return read_table(spark, d, "bench").select("id", text.query_text("instruction", "question").alias("query"), text.query_text("instruction", "question", True).alias("always"))


@R.query("SELECT rec_id, 'A: ' || coalesce(element_at(metadata, 'speaker_a')[1], '') || '; ch. ' || coalesce(element_at(metadata, 'chapter')[1], '') AS message, 4::BIGINT AS n_messages FROM ugf_forms_corpus")
def p08_p09_messages(spark, d):
    """A form's message and the chat around it."""
    t = read_table(spark, d, "ugf_forms_corpus").select("rec_id", F.col("metadata")["speaker_a"].alias("speaker_a"), F.col("metadata")["chapter"].alias("chapter"))
    message = selecting.filled_template("A: {speaker_a}; ch. {chapter}", ["speaker_a", "chapter"])
    chat = selecting.messages("Answer in plain words.", [("Hello?", "Yes.")], message)
    return t.select("rec_id", F.element_at(chat, -1)["content"].alias("message"), F.size(chat).cast("long").alias("n_messages"))


@R.query(f"""SELECT rec_id, trim(prompt_text) AS prompt, length(trim(reasoning))::BIGINT AS n_chars, CASE WHEN track = 'logic' THEN CASE verdict WHEN 'follows' THEN 'The case follows.' WHEN 'does not follow' THEN 'The case does not follow.' END ELSE trim(conclusion) END AS answer FROM ugf_cot
WHERE coalesce(compliant, false) AND trim(coalesce(prompt_text, '')) <> '' AND trim(coalesce(reasoning, '')) <> '' AND {WORDS.format("reasoning")} >= 10 AND NOT contains(lower(reasoning), 'so my answer is:')
AND ((track = 'logic' AND verdict IN ('follows', 'does not follow')) OR (track = 'philosophy' AND trim(coalesce(conclusion, '')) <> '' AND NOT contains(lower(conclusion), 'so my answer is:')))""")
def p10_think_answer(spark, d):
    """P10: usable chain-of-thought records as prompt, reasoning and answer."""
    return selecting.think_answer(read_table(spark, d, "ugf_cot")).select("rec_id", "prompt", F.char_length("thought").cast("long").alias("n_chars"), "answer")


@R.query("SELECT id, 'question->expected_answer' AS direction, question AS source_text, expected_answer AS target_text FROM bench UNION ALL SELECT id, 'expected_answer->question', expected_answer, question FROM bench")
def p11_both_directions(spark, d):
    """Each pair in both directions."""
    return selecting.both_directions(read_table(spark, d, "bench"), "question", "expected_answer").select("id", "direction", "source_text", "target_text")


@R.query("SELECT rec_id, len(map_keys(metadata))::BIGINT AS n_keys FROM ugf_reasoning WHERE len(map_keys(metadata)) > 0")
def p13_passthrough(spark, d):
    """Open columns passed through, null entries of a bag left out."""
    t = read_table(spark, d, "ugf_reasoning").withColumn("bag", selecting.known_entries("metadata"))
    return t.select("rec_id", "bag", selecting.without(t, "rec_id", "bag").alias("rest")).where((F.size("bag") > 0) & F.col("rest").isNotNull()).select("rec_id", F.size("bag").cast("long").alias("n_keys"))


@R.query(f"SELECT rec_id FROM ugf_cot WHERE NOT (regexp_replace(id, '-[^-]*$', '') IN (SELECT DISTINCT regexp_replace(id, '-[^-]*$', '') FROM bench WHERE expected_difficulty >= 4) OR {BUCKET.format('id')} < 500)")
def j01_j02_holdout(spark, d):
    """Rows outside the held-out documents and the hash bucket."""
    held = read_table(spark, d, "bench").where("expected_difficulty >= 4").select(keys.doc_key("id").alias("doc")).distinct()
    return dedup.excluded(read_table(spark, d, "ugf_cot"), held, keys.doc_key("id"), keys.in_holdout("id", 0.05)).select("rec_id")


@R.query("SELECT DISTINCT id FROM ugf_forms_corpus WHERE id NOT IN (SELECT id FROM ugf_forms_corpus WHERE NOT coalesce(failed, false))")
def j03_pending(spark, d):
    """Assignments without a completed record; failures count as pending again."""
    t = read_table(spark, d, "ugf_forms_corpus")
    return dedup.pending(t.select("id").distinct(), t.select("id", "failed"), "id", True, F.col("failed"))


@R.query("SELECT coalesce(b.type, 'unknown') AS type, count(*)::BIGINT AS n FROM comparator_holdout c LEFT JOIN (SELECT id, type FROM bench WHERE expected_difficulty IS NOT NULL) b USING (id) GROUP BY 1")
def j05_default_type(spark, d):
    """A type for every score, unknown where the source lacks it."""
    b = read_table(spark, d, "bench").where("expected_difficulty is not null").select("id", "type")
    return read_table(spark, d, "comparator_holdout").select("id").join(b, "id", "left").groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


@R.query("SELECT b.id, r.ugf_response AS run_response, c.ugf_response AS other_response FROM bench b JOIN (SELECT id, arg_max(struct_pack(x := ugf_response), rec_id).x AS ugf_response FROM bench_run GROUP BY id) r USING (id) JOIN (SELECT id, arg_max(struct_pack(x := ugf_response), rec_id).x AS ugf_response FROM comparator_holdout GROUP BY id) c USING (id)")
def j06_three_way(spark, d):
    """Ids in all of three tables, the last row of a repeated id counting."""
    last = lambda t: dedup.last_by(read_table(spark, d, t).select("id", "rec_id", "ugf_response"), ["id"], "rec_id").drop("rec_id")
    return read_table(spark, d, "bench").select("id").join(last("bench_run").withColumnRenamed("ugf_response", "run_response"), "id").join(last("comparator_holdout").withColumnRenamed("ugf_response", "other_response"), "id")


@R.query("SELECT b.id, CASE WHEN coalesce(l.v, '') <> '' THEN l.v ELSE b.question END AS question, coalesce(l.v <> '', false) AS was_patched FROM bench b LEFT JOIN (SELECT id, max(english_query) AS v FROM comparator_holdout WHERE batch_label <= 'comparator_holdout_batch_02' GROUP BY id) l USING (id)")
def j07_patched(spark, d):
    """Questions replaced where a lookup holds a fuller one."""
    lookup = read_table(spark, d, "comparator_holdout").where("batch_label <= 'comparator_holdout_batch_02'").groupBy("id").agg(F.max("english_query").alias("v"))
    return dedup.patched(read_table(spark, d, "bench").select("id", "question"), lookup, "id", "question", "v").select("id", "question", "was_patched")


@R.query("SELECT r.prompt_id, count(*)::BIGINT AS n, max(r.reward) AS best_reward, max(x.best) AS all_best FROM rl_rollouts r LEFT JOIN (SELECT prompt_id, max(reward) AS best FROM rl_rollouts WHERE policy = 'best_of_n' GROUP BY 1) x USING (prompt_id) GROUP BY 1")
def j09_optional_reference(spark, d):
    """Each prompt beside its best reference, where there is one; both sides aggregated first."""
    t = read_table(spark, d, "rl_rollouts")
    refs = t.where("policy = 'best_of_n'").groupBy("prompt_id").agg(F.max("reward").alias("all_best"))
    return t.groupBy("prompt_id").agg(F.count("*").alias("n"), F.max("reward").alias("best_reward")).join(refs, "prompt_id", "left")


@R.query("SELECT a.id, md5('5|' || a.id)[1] IN ('0','1','2','3','4','5','6','7') AS a_first FROM (SELECT DISTINCT id FROM bench_run WHERE run_label < 'sft_form_stress_norep_20260115') a JOIN (SELECT DISTINCT id FROM bench_run WHERE run_label >= 'sft_form_stress_norep_20260115') b USING (id)")
def j13_m06_pairs(spark, d):
    """Prompts answered under both conditions, the slot by a coin."""
    t = read_table(spark, d, "bench_run").select("id", "run_label")
    cut = "sft_form_stress_norep_20260115"
    a, b = t.where(F.col("run_label") < cut).select("id").distinct(), t.where(F.col("run_label") >= cut).select("id").distinct()
    return a.join(b, "id").select("id", sampling.coin(5, "id").alias("a_first"))


@R.query("SELECT n_name, r_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j11_dimensions(spark, d):
    """A star of dimensions."""
    c, n, r = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@R.query("SELECT coalesce(source, 'none') AS source, count(*)::BIGINT AS n, count(DISTINCT substr(md5(trim(text)), 1, 12))::BIGINT AS n_texts, count(DISTINCT work_id)::BIGINT AS n_works FROM documents WHERE text IS NOT NULL GROUP BY 1")
def u01_exact_duplicates(spark, d):
    """Documents, distinct texts within the source, works."""
    docs = read_table(spark, d, "documents").where("text is not null")
    firsts = dedup.exact(docs.select("doc_id", "source", "text"), "text", "doc_id", ["source"]).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n_texts"))
    base = docs.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.countDistinct("work_id").alias("n_works"))
    return base.join(firsts, "source").select("source", "n", "n_texts", "n_works")


@R.query("SELECT id, rec_id, content_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, rec_id) AS k FROM ugf_reasoning) WHERE k = 1")
def u02_first_record(spark, d):
    """The first record of each id."""
    return dedup.first_by(read_table(spark, d, "ugf_reasoning").select("id", "rec_id", "content_type", "ingested_at"), ["id"], "ingested_at", "rec_id").drop("ingested_at")


@R.query("SELECT id, rec_id, content_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, rec_id DESC) AS k FROM ugf_reasoning) WHERE k = 1")
def u03_last_record(spark, d):
    """The last record of each id."""
    return dedup.last_by(read_table(spark, d, "ugf_reasoning").select("id", "rec_id", "content_type", "ingested_at"), ["id"], "ingested_at", "rec_id").drop("ingested_at")


@R.query("SELECT 'records' AS side, count(*)::BIGINT AS n FROM ugf_forms_corpus WHERE coalesce(compliant, true) UNION ALL SELECT 'progress', count(*)::BIGINT FROM (SELECT DISTINCT id FROM ugf_forms_corpus WHERE id NOT IN (SELECT id FROM ugf_forms_corpus WHERE NOT coalesce(compliant, true)))")
def u06_strip(spark, d):
    """Records and progress without what isn't compliant."""
    t = read_table(spark, d, "ugf_forms_corpus")
    kept, progress = dedup.stripped(t, t.select("id").distinct(), "id")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(kept, "records").unionAll(count(progress, "progress"))


@R.query("SELECT 'run' AS system, count(*)::BIGINT AS n FROM bench_run UNION ALL SELECT 'comparator', count(*)::BIGINT FROM comparator_holdout")
def u04_union(spark, d):
    """Sources under constant tags."""
    parts = [read_table(spark, d, t).select("id", F.lit(s).alias("system")) for t, s in (("bench_run", "run"), ("comparator_holdout", "comparator"))]
    return reduce(DataFrame.unionByName, parts).groupBy("system").agg(F.count("*").alias("n"))


@R.query("SELECT id FROM (SELECT id FROM bench_run INTERSECT SELECT id FROM comparator_holdout) EXCEPT SELECT id FROM bench WHERE expected_difficulty >= 4")
def u05_u06_sets(spark, d):
    """Intersection and difference of id sets."""
    ids = lambda t: read_table(spark, d, t).select("id")
    return ids("bench_run").intersect(ids("comparator_holdout")).subtract(read_table(spark, d, "bench").where("expected_difficulty >= 4").select("id"))


@R.query(f"SELECT coalesce(source, 'none') AS source, count(*)::BIGINT AS n, count(*) FILTER ({BUCKET.format('work_id')} < 500)::BIGINT AS n_held FROM documents GROUP BY 1")
def h01_stable_split(spark, d):
    """H1: the stable split by work."""
    return read_table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count(F.when(keys.in_holdout("work_id", 0.05), 1)).alias("n_held"))


@R.query("""WITH docs AS (SELECT DISTINCT source, regexp_replace(work_id, '-[^-]*$', '') || '-' || work_id AS id, work_id FROM documents WHERE source IS NOT NULL), s AS (SELECT DISTINCT source, regexp_replace(id, '-[^-]*$', '') AS doc FROM docs),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('9|' || source || '|' || doc), source, doc) AS k, count(*) OVER (PARTITION BY source) AS n FROM s)
SELECT source, doc FROM r WHERE k <= greatest(1, round_even(n * 0.05, 0))""")
def h02_document_holdout(spark, d):
    """H2: whole documents held out of each source, at least one."""
    docs = read_table(spark, d, "documents").where("source is not null").select("source", F.concat(keys.doc_key("work_id"), F.lit("-"), "work_id").alias("id"))
    return sampling.holdout_documents(docs, 0.05, "source", "id", 9)


@R.query("SELECT id FROM bench ORDER BY md5('3|' || id), id LIMIT 60")
def m01_m02_uniform(spark, d):
    """M1, M2, M9: a seeded sample as a top-k."""
    return sampling.uniform(read_table(spark, d, "bench"), 60, 3, "id").select("id")


@R.query("""WITH s AS (SELECT rec_id, content_type, row_number() OVER (PARTITION BY content_type ORDER BY md5('4|' || rec_id), rec_id) AS k, count(*) OVER (PARTITION BY content_type) AS n, (SELECT count(*) FROM ugf_reasoning) AS t FROM ugf_reasoning)
SELECT rec_id, content_type FROM s WHERE k <= greatest(1, round_even(300.0 * n / t, 0)) ORDER BY md5('5|' || rec_id), rec_id LIMIT 300""")
def m03_stratified(spark, d):
    """M3: a stratified sample by share."""
    return sampling.stratified(read_table(spark, d, "ugf_reasoning").select("rec_id", "content_type"), 300, "content_type", 4, "rec_id")


@R.query("SELECT teacher, count(*)::BIGINT AS n FROM (SELECT CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS teacher FROM (SELECT ('0x' || substr(md5('6|' || id), 1, 8))::BIGINT / 4294967296.0 AS u FROM ugf_cot)) GROUP BY 1")
def m04_weighted(spark, d):
    """M4, M8: assignment by weight."""
    return read_table(spark, d, "ugf_cot").select(sampling.weighted_choice(6, [("a", 5), ("b", 3), ("c", 2)], "id").alias("teacher")).groupBy("teacher").agg(F.count("*").alias("n"))


@R.query("WITH p AS (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM bench), q AS (SELECT range AS draw, floor(('0x' || substr(md5('8|' || range), 1, 8))::BIGINT / 4294967296.0 * (SELECT count(*) FROM bench))::BIGINT + 1 AS k FROM range(1200)) SELECT draw::BIGINT AS draw, id FROM q JOIN p USING (k)")
def m05_replacement(spark, d):
    """M5: more draws than the pool holds."""
    return sampling.with_replacement(read_table(spark, d, "bench").select("id"), 1200, 8, "id")


@R.query("SELECT source, tier, rec_id, tier_size FROM (SELECT source, form AS tier, rec_id, count(*) OVER (PARTITION BY source, form)::BIGINT AS tier_size, row_number() OVER (PARTITION BY source, form ORDER BY md5('2|' || rec_id), rec_id) AS k FROM ugf_forms_corpus) WHERE k = 1")
def m07_tiered(spark, d):
    """M7: one row of each tier."""
    t = read_table(spark, d, "ugf_forms_corpus").select("source", F.col("form").alias("tier"), "rec_id")
    return sampling.one_per_tier(t, ["source", "tier"], 2, "rec_id").select("source", "tier", "rec_id", "tier_size")


@R.query("SELECT id, ['low', 'medium', 'high'][(row_number() OVER (ORDER BY id) - 1) % 3 + 1] AS assigned FROM bench")
def w07_w12_round_robin(spark, d):
    """Choices in turn."""
    return sampling.round_robin(read_table(spark, d, "bench").select("id"), ["low", "medium", "high"], "id").select("id", "assigned")


@R.query("SELECT id, rec_id FROM (SELECT *, row_number() OVER (ORDER BY rec_id) AS k FROM comparator_holdout) WHERE k BETWEEN 101 AND 200")
def l01_offset_limit(spark, d):
    """L1: an offset and a limit in scan order."""
    return numbering.numbered(read_table(spark, d, "comparator_holdout").select("id", "rec_id"), "rec_id").where(F.col("rn").between(101, 200)).select("id", "rec_id")


@R.query("SELECT type, category, count(*)::BIGINT AS n FROM bench GROUP BY 1, 2")
def a22_mix(spark, d):
    """Composition."""
    return read_table(spark, d, "bench").groupBy("type", "category").agg(F.count("*").alias("n"))
