"""Session construction and the settings that operators read from a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; `conf` wins over the defaults."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app).config(map=defaults | conf)
    return (builder.master(master) if master else builder).getOrCreate()


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Where that setting is absent and the session is a local one, as in tests, a temporary folder, which is removed when
    the process ends. A cluster without the setting is refused.
    """
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit range partitioning: the configured shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a plan's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan_tasks(df: DataFrame) -> int:
    """About as many as the tasks that read df, and two a core at least: one for 16 MB of the columns in use."""
    return int(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, estimated_bytes(df) // (16 << 20)), 1 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_SHARE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores, for work that is heavy a row.

    A file of one row group is one task however many cores there are. Only inputs of less than SMALL_SHARE bytes a core
    are dealt out anew, so the shuffle is bounded; larger ones keep the tasks of their scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and estimated_bytes(df) < cores * SMALL_SHARE else df
