"""Readers of records, maps and texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import lstrip, strip

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, on any file system the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def records(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, absent fields are null."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def lenient(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The well-formed records, and how many lines were malformed."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = spark.read.text(path).where(strip("value") != "").select(parsed.alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    return rows.where(~bad).select(*[F.col(f"r.{n}").alias(n) for n in schema.fieldNames()]), rows.agg(F.count(F.when(bad, 1)).alias("n_malformed"), F.count("*").alias("n_lines"))


def file_label(pattern: str) -> Column:
    """What the pattern's first group finds in the name of the file of each row."""
    return F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), pattern, 1)


def labelled(spark: SparkSession, glob: str, schema: T.StructType, pattern: str) -> DataFrame:
    """Many files with a label from each one's name."""
    df = spark.read.schema(schema).json(glob)
    return df.select(*schema.fieldNames(), file_label(pattern).alias("label"))


def tagged_union(parts: Sequence[tuple[dict[str, str], DataFrame]]) -> DataFrame:
    """Sources under constant tags, as one table."""
    return reduce(DataFrame.unionByName, [df.withColumns({k: F.lit(v) for k, v in tags.items()}) for tags, df in parts])


def object_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object as rows (key, value fields). value: the DDL type of the values."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    return rows.select("key", "value.*") if value.lower().startswith("struct") else rows


def between_markers(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Whole texts from the start marker to the end marker; null without the former."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    at = F.instr("value", start)
    tail = F.when(at > 0, F.expr("substring(value, instr(value, '" + start.replace("'", "\\'") + "'))"))
    return whole.select("path", F.substring_index(tail, end, 1).alias("text"))


def tree(spark: SparkSession, root: str, pattern: str = "*.md", leave_out: Sequence[str] = ()) -> DataFrame:
    """Whole texts of a folder tree, files whose name holds one of the words left out."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    for word in leave_out:
        df = df.where(~name.contains(word.lower()))
    return df


def prompts(lines: DataFrame, keys: Sequence[str] = ("prompt", "english_query", "question", "text")) -> DataFrame:
    """Prompts from lines that are plain or JSON: of an object the first non-empty of the keys."""
    of_json = F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{k}"), F.lit("")) for k in keys])
    return lines.where(strip("value") != "").select(F.when(lstrip("value").startswith("{"), of_json).otherwise(strip("value")).alias("prompt")).where("prompt is not null")


def first_of_each(parts: Sequence[tuple[dict[str, str], DataFrame]], order: str, limit: int | None = None) -> DataFrame:
    """A registry of sources under their tags, of each the first `limit` rows in order."""
    return tagged_union([(tags, df if limit is None else df.orderBy(order).limit(limit)) for tags, df in parts])


def settings(path: str) -> dict:
    """A configuration file: YAML where a reader is installed, else JSON."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(body)
    return yaml.safe_load(body)
