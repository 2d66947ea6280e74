"""The queries of the training-data problems and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import abuse, leakage, mixing, neardup, packing, pairs, truncation
from textquarry.llm.tokens import token_counts
from textquarry.session import materialise, read_table

#: Problem 3: table, text column.
REWORKED = (("ugf_cot", "reasoning"), ("ugf_forms_corpus", "response"), ("ugf_reasoning", "ugf_text"))
NEAR = {"shingle": 3, "threshold": 0.6, "min_words": 30}
#: Problem 4: table, key, text column, source column.
CUT = (("comparator_holdout", "rec_id", "ugf_response", "comparator_model"), ("rl_rollouts", "rollout_id", "completion_text", "policy"), ("ugf_cot", "rec_id", "reasoning", "source_model"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bench_run").select("rec_id", "prompt", F.col("ugf_response").alias("response"), F.col("failure_mode").alias("hint"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The defect of each defective pair."""
    return pairs.main_defect(_pairs(spark, d))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """All defects whose posterior exceeds the cutoff, with the posterior."""
    return pairs.labels(_pairs(spark, d))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("rec_id"), "text")
    return docs.unionAll(read_table(spark, d, "ugf_cot").select(F.lit("ugf_cot").alias("corpus"), "rec_id", F.col("prompt_text").alias("text")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bench").select(F.col("id").alias("item_id"), F.col("english_query").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that carry ten or more consecutive words of an item."""
    return leakage.leaks(_scanned(spark, d), _items(spark, d)).select("corpus", "rec_id", "item_id")


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same with the longest run and its place in the original text."""
    return leakage.leaks(_scanned(spark, d), _items(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """How far each test item leaked."""
    return leakage.leak_report(leakage.leaks(_scanned(spark, d), _items(spark, d)), _items(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of reworked copies within each table."""
    return _union([neardup.similar_pairs(read_table(spark, d, t), "rec_id", c, **NEAR).select(F.lit(t).alias("corpus"), "rec_a", "rec_b") for t, c in REWORKED])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each row, its size and the row's number of links."""
    return _union([neardup.groups(read_table(spark, d, t), "rec_id", c, **NEAR).withColumn("corpus", F.lit(t)) for t, c in REWORKED])


def _cut_input(spark: SparkSession, d: str) -> DataFrame:
    return _union([read_table(spark, d, t).select(F.lit(t).alias("corpus"), F.col(k).cast("long").alias("rec_id"), F.col(s).alias("source"), F.col(c).alias("text")) for t, k, c, s in CUT])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose text was cut off."""
    return truncation.cut_texts(_cut_input(spark, d)).select("corpus", "rec_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each comparator_model, policy and source_model cuts its texts."""
    return truncation.cut_rates(_cut_input(spark, d))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """By which evidence the cut texts of each source were found."""
    return truncation.cut_evidence(_cut_input(spark, d))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of each document, counted once."""
    docs = read_table(spark, d, "documents")
    return materialise(token_counts(docs), "sizes")


def p5_layout(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its place in the sequences of each pack."""
    return packing.layout(_sizes(spark, d), read_table(spark, d, "pack_sizes"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """How well each pack is filled."""
    return packing.report(p5_layout(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).join(read_table(spark, d, "documents").select("doc_id", "source"), "doc_id")


def p6_draw(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn from each source and how often."""
    return mixing.draw(_sized(spark, d), read_table(spark, d, "mix_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, beside the targets."""
    sized, targets = _sized(spark, d), read_table(spark, d, "mix_targets")
    return mixing.shares(mixing.draw(sized, targets), sized, targets)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return abuse.scores(docs, abuse.fit(docs, read_table(spark, d, "review_labels")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with abusive, hateful or sexual content."""
    return _scored(spark, d).where("is_abusive").select("doc_id")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d)


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rates of each source."""
    return abuse.rates(read_table(spark, d, "documents"), _scored(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_labels": p1_labels,
    "p2_found": p2_found,
    "p2_spans": p2_spans,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p4_evidence": p4_evidence,
    "p5_layout": p5_layout,
    "p5_report": p5_report,
    "p6_draw": p6_draw,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_scores": p7_scores,
    "p7_rates": p7_rates,
}

SQL: dict[str, str] = {}
