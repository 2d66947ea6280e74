"""Incremental forms on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textquarry.operators.dedup import pending
from textquarry.session import ship


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder, so many a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def completed(df: DataFrame, out: str, checkpoint: str, key: str, worker: str, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, retry_failures: bool = False):
    """Producer and consumer: pending assignments go to the model's client, spread by worker; results and
    failures are appended, and a batch that is run again writes the same place. A key that is done is not
    asked for again, by way of an anti-join on what is written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield call(b)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ship(spark)
        done = _written(spark, out, schema, batch_id)
        todo = pending(batch, done, key, retry_failures, F.col("failed") if retry_failures else None)
        todo.repartition(F.col(worker)).mapInPandas(run, schema).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _written(spark: SparkSession, out: str, schema: str, batch_id: int) -> DataFrame:
    """What the earlier batches wrote; not what a failed run of this one may have left."""
    from textquarry.sources.jsonl import exists

    if not exists(spark, f"{out}/batch_id=*/*.parquet"):
        return spark.createDataFrame([], schema)
    typed = T._parse_datatype_string(schema).add("batch_id", T.LongType())
    return spark.read.schema(typed).option("basePath", out).parquet(f"{out}/batch_id=*").where(F.col("batch_id") < batch_id).drop("batch_id")


def settled(attempts: DataFrame, key: str = "id", order: str = "attempt", ok: str = "compliant") -> DataFrame:
    """The outcome of a validate-and-retry loop: the first compliant attempt, else the last; with the number of attempts."""
    cols = [c for c in attempts.columns if c != key]
    rank = F.struct(F.when(F.coalesce(F.col(ok), F.lit(False)), 0).otherwise(1), F.when(F.coalesce(F.col(ok), F.lit(False)), F.col(order)).otherwise(-F.col(order)))
    best = attempts.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("_r"), F.count("*").alias("n_attempts"))
    return best.select(key, "_r.*", "n_attempts")


def closed(assigned: DataFrame, results: DataFrame, key: str, reason: str = "no result") -> DataFrame:
    """A record for every assignment: where no result came, a failure."""
    got = results.withColumn("_got", F.lit(True))
    return assigned.select(key).join(got, key, "left").withColumns({"failed": F.col("_got").isNull(), "failure_reason": F.when(F.col("_got").isNull(), reason)}).drop("_got")


def running_counts(df: DataFrame, *by: str, flag: str = "compliant") -> DataFrame:
    """Running totals of a group and of its compliant rows; for complete output."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.coalesce(F.col(flag), F.lit(False)), 1)).alias("n_ok"))


def windowed(df: DataFrame, ts: str, width: str, late: str, *by: str, value: str) -> DataFrame:
    """Counts and sums of event-time windows, late rows within the watermark included."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


HALTED = "key string, step long, trailing double, halt boolean"


def halting(df: DataFrame, key: str, step: str, value: str, rows: int = 50, most: float = 0.15) -> DataFrame:
    """The trailing rule of a training run as a stream: for each row the mean of the last `rows` values of
    its key and whether it exceeds the bound. The state is those values alone."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values(step).itertuples():
            held = [*held, float(getattr(row, value))][-rows:]
            mean = sum(held) / len(held)
            out.append((str(k[0]), int(getattr(row, step)), mean, len(held) == rows and mean > most))
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "step", "trailing", "halt"])

    ship(df.sparkSession)
    return df.groupBy(key).applyInPandasWithState(update, HALTED, "held array<double>", "append", GroupStateTimeout.NoTimeout)


class Bucket:
    """A token bucket for a client at the engine's edge; time is passed in."""

    def __init__(self, rate_per_min: float, burst: float):
        self.rate, self.burst, self.tokens, self.at = rate_per_min / 60.0, burst, burst, 0.0

    def _fill(self, now: float) -> None:
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), max(now, self.at)

    def set_rate(self, rate_per_min: float, now: float) -> None:
        self._fill(now)
        self.rate = rate_per_min / 60.0

    def wait(self, now: float) -> float:
        """Take one token; the seconds until it may be used."""
        self._fill(now)
        self.tokens -= 1
        return max(0.0, -self.tokens / self.rate)


def backoff(attempt: int, base: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait before the next attempt."""
    return min(most, base * 2**attempt)


def retried(call: Callable[[], object], transient: tuple[type[BaseException], ...], attempts: int = 4, sleep: Callable[[float], None] = lambda s: None) -> object:
    """call(), again after a transient failure."""
    for k in range(attempts):
        try:
            return call()
        except transient:
            if k == attempts - 1:
                raise
            sleep(backoff(k))
    raise AssertionError
