"""Streams over tables that are folders of parts, as larger tables are."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.plans.catalogue import QUERIES

ROLLOUTS = [(k, k % 7 if k % 11 else None, [None, "", "a", "b\n\"c\""][k % 4]) for k in range(200)]


@pytest.mark.parametrize("by", [[], ["track"]])
def test_metric_rows_of_a_table_in_parts(spark, tmp_path, by):
    df = spark.createDataFrame(ROLLOUTS, "rollout_id long, step int, policy string").withColumn("track", F.concat(F.lit("t"), F.col("rollout_id") % 3))
    df.repartition(3).write.partitionBy(*by).parquet(f"{tmp_path}/rl_rollouts.parquet")
    got = {(r.policy, r.step): r.n for r in QUERIES["k07_metric_rows"](spark, str(tmp_path)).collect()}
    assert got == Counter(("none" if p is None else p, s) for _, s, p in ROLLOUTS)


def test_metric_rows_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "rollout_id long, step int, policy string").write.parquet(f"{tmp_path}/rl_rollouts.parquet")
    assert QUERIES["k07_metric_rows"](spark, str(tmp_path)).collect() == []
