"""Queries through the readers, writers and streams: tables written to the shared folder and read again."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.plans.registry import Registry
from textquarry.session import read_table, shared_dir
from textquarry.sources import jsonl, sinks
from textquarry.streaming import pipelines

R = Registry()


def _place(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    """One table of a data folder as a stream, whether it is one file or a folder of parts: a stream's path
    must be a folder, and a filter by the table's name would pass none of its parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    files = spark.readStream.schema(read_table(spark, d, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return files.parquet(f"{d}/{name}.parquet")
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(d)


BENCH = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "category", "question")] + [T.StructField("expected_difficulty", T.IntegerType())])


@R.query("SELECT id, type, category, question, expected_difficulty FROM bench")
def s01_k01_json_lines(spark, d):
    """Records written as JSON lines and read under a declared schema."""
    path = _place(spark, "jsonl")
    sinks.write_records(read_table(spark, d, "bench").select(*BENCH.fieldNames()), path)
    return jsonl.records(spark, path, BENCH)


@R.query("SELECT count(*) FILTER (expected_difficulty IS NULL)::BIGINT AS n_malformed, count(*)::BIGINT AS n_lines FROM bench")
def s02_lenient(spark, d):
    """Malformed lines counted, the others kept."""
    path = _place(spark, "lenient")
    rows = read_table(spark, d, "bench")
    rows.select(F.when(F.col("expected_difficulty").isNull(), F.concat(F.lit('{"id": '), "id")).otherwise(F.to_json(F.struct("id", "type"))).alias("value")).write.text(path)
    return jsonl.lenient(spark, path, T.StructType(BENCH.fields[:2]))[1]


@R.query("SELECT 'present' AS kind, count(*)::BIGINT AS n FROM bench UNION ALL SELECT 'missing', 0")
def s03_missing(spark, d):
    """S3: a missing file is an empty table."""
    path = _place(spark, "maybe")
    sinks.write_records(read_table(spark, d, "bench").select(*BENCH.fieldNames()), path)
    count = lambda p, k: jsonl.records(spark, p, BENCH, True).agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return count(path, "present").unionAll(count(path + "-none", "missing"))


@R.query("SELECT type AS label, count(*)::BIGINT AS n FROM bench GROUP BY 1")
def s04_s05_file_labels(spark, d):
    """Many files, each one's label from its name."""
    path = _place(spark, "labels")
    read_table(spark, d, "bench").select("id", F.col("type").alias("t")).write.partitionBy("t").json(path)
    df = spark.read.schema("id string").json(f"{path}/t=*").select(F.regexp_extract(F.col("_metadata.file_path"), r"/t=([^/]+)/", 1).alias("label"))
    return df.groupBy("label").agg(F.count("*").alias("n"))


@R.query("SELECT id AS key, type, category FROM bench")
def s09_object_map(spark, d):
    """An object of objects as rows."""
    path = _place(spark, "map")
    entries = read_table(spark, d, "bench").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct("type", "category"))))).alias("value"))  # one object: a test map of fixed size
    entries.write.text(path)
    return jsonl.object_map(spark, path, "struct<type:string, category:string>")


@R.query("SELECT DISTINCT topic AS word FROM documents WHERE regexp_matches(topic, '^[a-z][''a-z]*$') UNION SELECT unnest(['and', 'but', 'don''t'])")
def s10_word_literal(spark, d):
    """The words of a script's literal."""
    from textquarry.operators.vocabulary import word_list

    path = _place(spark, "js")
    topics = read_table(spark, d, "documents").select("topic").distinct().agg(F.array_join(F.collect_set("topic"), "|").alias("t"))
    topics.select(F.concat(F.lit('/* list */\nwindow.__WORDS = "and|but|don\'t|B2|'), "t", F.lit('";')).alias("value")).coalesce(1).write.text(path)
    return word_list(spark, path)


@R.query("SELECT id, 'before ' || question AS text FROM bench WHERE type = 'modal'")
def s07_s08_marked_texts(spark, d):
    """Whole texts between markers."""
    path = _place(spark, "whole")
    b = read_table(spark, d, "bench").where("type = 'modal'")
    b.select("id", F.concat(F.lit("head\n*** START\nbefore "), "question", F.lit("\n*** END\nfoot")).alias("value")).write.partitionBy("id").text(path)
    cut = jsonl.between_markers(spark, f"{path}/id=*/*.txt", "*** START", "*** END")
    return cut.select(F.regexp_extract("path", r"/id=([^/]+)/", 1).alias("id"), F.regexp_replace(F.regexp_replace("text", r"^\*\*\* START\n", ""), r"\n$", "").alias("text"))


@R.query("SELECT prompt, count(*)::BIGINT AS n FROM (SELECT trim(question) AS prompt FROM bench WHERE expected_difficulty IS NULL UNION ALL SELECT question FROM bench WHERE expected_difficulty IS NOT NULL AND question <> '') GROUP BY 1")
def s13_prompts(spark, d):
    """Prompts from plain lines and JSON lines mixed."""
    b = read_table(spark, d, "bench")
    line = F.when(F.col("expected_difficulty").isNull(), F.col("question")).otherwise(F.to_json(F.struct(F.lit("").alias("prompt"), F.col("question").alias("question"))))
    return jsonl.prompts(b.select(line.alias("value"))).groupBy("prompt").agg(F.count("*").alias("n"))


@R.query("SELECT '{' || string_agg('\"' || word || '\":' || (k + 26)::VARCHAR, ',' ORDER BY word) || '}' AS value FROM (SELECT topic AS word, row_number() OVER (ORDER BY topic) AS k FROM (SELECT DISTINCT topic FROM documents WHERE regexp_matches(topic, '^[a-z]+$')))")
def k05_vocabulary_json(spark, d):
    """A vocabulary as one JSON object."""
    from textquarry.operators.vocabulary import with_ids

    words = read_table(spark, d, "documents").select(F.col("topic").alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    return sinks.vocabulary_json(with_ids(words).where("id > 26"))


@R.query("SELECT form, source, rec_id FROM (SELECT 'essay' AS form, 'lamp' AS source, rec_id FROM ugf_forms_corpus WHERE source = 'lamp_essays' ORDER BY rec_id LIMIT 25) UNION ALL SELECT form, source, rec_id FROM (SELECT 'talk' AS form, 'north' AS source, rec_id FROM ugf_forms_corpus WHERE source = 'northgate_talks' ORDER BY rec_id LIMIT 25)")
def s06_registry(spark, d):
    """A registry of sources, the first records of each."""
    t = read_table(spark, d, "ugf_forms_corpus")
    parts = [({"form": f, "source": s}, t.where(F.col("source") == name).select("rec_id")) for f, s, name in (("essay", "lamp", "lamp_essays"), ("talk", "north", "northgate_talks"))]
    return jsonl.first_of_each(parts, "rec_id", 25)


@R.query("SELECT policy, step FROM (SELECT policy, step, row_number() OVER (PARTITION BY policy ORDER BY step DESC) AS k FROM (SELECT DISTINCT coalesce(policy, 'none') AS policy, step FROM rl_rollouts)) WHERE k <= 3")
def w18_retention(spark, d):
    """The last three steps of each run are kept."""
    t = read_table(spark, d, "rl_rollouts").select(F.coalesce("policy", F.lit("none")).alias("policy"), "step").distinct()
    return sinks.retained(t, "step", 3, "policy")


@R.query("SELECT '| type | n |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || type || ' | ' || count(*) || ' |' FROM bench GROUP BY type")
def k06_t38_report(spark, d):
    """An aggregated result as a Markdown table."""
    agg = read_table(spark, d, "bench").groupBy("type").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in sinks.markdown(agg, ["type", "n"]).split("\n")], "line string")


@R.query("SELECT policy, step, n FROM (SELECT coalesce(policy, 'none') AS policy, step, count(*)::BIGINT AS n FROM rl_rollouts GROUP BY 1, 2)")
def k07_metric_rows(spark, d):
    """Metric rows of a stream appended batch by batch."""
    out = _place(spark, "metrics")
    t = _stream(spark, d, "rl_rollouts")
    q = sinks.append_metrics(t.select(F.coalesce("policy", F.lit("none")).alias("policy"), "step"), out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("policy string, step int").json(f"{out}/batch_id=*").groupBy("policy", "step").agg(F.count("*").alias("n"))


def _events(spark, d):
    return spark.readStream.schema(read_table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (value > 50)::BIGINT AS n_ok FROM events GROUP BY 1")
def z03_running_counts(spark, d):
    """Running totals of a stream, taken at its end."""
    out = _place(spark, "running")
    counts = pipelines.running_counts(_events(spark, d).withColumn("compliant", F.col("value") > 50), "event_type")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}")).trigger(availableNow=True).option("checkpointLocation", out + "-state").start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/{q.lastProgress['batchId'] if q.lastProgress else 0}")


@R.query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def z04_windows(spark, d):
    """An extension: event-time windows under a watermark, the stream read to its end."""
    out = _place(spark, "windows")
    w = pipelines.windowed(_events(spark, d), "ts", "1 hour", "1 day", "event_type", value="value")
    rows = w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))
    q = rows.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}")).trigger(availableNow=True).option("checkpointLocation", out + "-state").start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/{q.lastProgress['batchId'] if q.lastProgress else 0}")


@R.query("SELECT event_id AS id, user_id % 4 AS worker, upper(event_type) AS text, false AS failed FROM events")
def z01_z02_completed(spark, d):
    """Pending assignments through a client at the engine's edge; a second run adds
    nothing."""
    schema = "id long, worker long, text string, failed boolean"
    out = _place(spark, "completed")

    def client(b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(text=b["event_type"].str.upper(), failed=False)[["id", "worker", "text", "failed"]]

    for _ in range(2):
        assigned = _events(spark, d).select(F.col("event_id").alias("id"), F.pmod("user_id", F.lit(4)).alias("worker"), "event_type")
        q = pipelines.completed(assigned, f"{out}/data", f"{out}/state", "id", "worker", client, schema).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("batch_id")


@R.query("SELECT user_id::VARCHAR AS key, event_id AS step, n = 50 AND t > 50 AS halt FROM (SELECT user_id, event_id, avg(value) OVER w AS t, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))")
def z09_halting_stream(spark, d):
    """The trailing rule kept as state of a stream."""
    out = _place(spark, "halting")
    rows = pipelines.halting(_events(spark, d).select("user_id", F.col("event_id").alias("step"), "value"), "user_id", "step", "value", 50, 50.0)
    q = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("key", "step", "halt")
