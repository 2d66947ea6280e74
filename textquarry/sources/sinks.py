"""Writers of records, batches, vocabularies and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.numbering import batches


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, characters as they are."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_batches(df: DataFrame, path: str, label: str, size: int, *order: str) -> DataFrame:
    """A folder for each batch of `size` rows, and the manifest: label, batch, n_items, path."""
    out = batches(df, *order, size=size)
    out.drop("rn", "place").write.mode("overwrite").partitionBy("batch").json(path)
    return manifest(out, label, path)


def manifest(batched: DataFrame, label: str, path: str) -> DataFrame:
    return batched.groupBy("batch").agg(F.count("*").alias("n_items")).select(F.lit(label).alias("label"), "batch", "n_items", F.concat(F.lit(f"{path}/batch="), F.col("batch").cast("string")).alias("path"))


def rewrite(df: DataFrame, path: str, suffix: str = ".new") -> str:
    """Written beside the old data, which stays as the backup; the caller switches over."""
    df.write.mode("errorifexists").json(path + suffix)
    return path + suffix


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one JSON object; a dimension of thousands."""
    return vocab.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "id"))))).alias("value"))


def write_words(words: DataFrame, path: str) -> None:
    words.select("word").coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """A table of an aggregated result."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in df.select(*columns).toLocalIterator()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *rows])


def html_table(df: DataFrame, columns: Sequence[str], title: str, digits: int = 3) -> str:
    """A page with the table of an aggregated result, text escaped."""
    from html import escape

    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else escape(str(v)).replace("\n", "<br>")
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "\n".join("<tr>" + "".join(f"<td>{show(r[c])}</td>" for c in columns) + "</tr>" for r in df.select(*columns).toLocalIterator())
    return f"<!doctype html>\n<title>{escape(title)}</title>\n<h1>{escape(title)}</h1>\n<table>\n<tr>{head}</tr>\n{body}\n</table>\n"


def retained(df: DataFrame, order: str, keep: int, *by: str) -> DataFrame:
    """The last `keep` rows of each group, as old checkpoints are let go."""
    from pyspark.sql import Window

    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_k") <= keep).drop("_k")


def append_metrics(df: DataFrame, path: str):
    """A stream of metric rows appended as JSON lines; exactly once for each batch id."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return df.writeStream.foreachBatch(add)
