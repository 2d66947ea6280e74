"""Session builder, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[8]", name: str = "textquarry", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; keyword arguments override them. The number of
    shuffle partitions and the driver's memory are the cluster's to set."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once: its executors needn't have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="textquarry-code-"), "textquarry.zip")  # the driver serves it to the executors
    with zipfile.PyZipFile(archive, "w", optimize=-1) as z:
        z.writepy(os.path.join(_ROOT, "textquarry"))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow by a function of this package, wherever df came from."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset, a session whose
    executors are threads of this machine (as in tests) gets a folder of its own; on a cluster that is
    an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut by files that outlive any
    executor. The schema of the result equals that of df. What was written is deleted by discard, by
    clean, or when the driver ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(stage: DataFrame) -> None:
    """Delete a materialised stage that nothing reads any more."""
    path = stage._written_at
    _delete(stage.sparkSession, path)
    _written[:] = [x for x in _written if x[1] != path]


def clean() -> None:
    """Delete all materialised stages; for when no result that reads them is still to be computed."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  (the session may be gone)
            return


atexit.register(clean)
