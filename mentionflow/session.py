"""Session helpers: building a session for tests/benchmarks, locating the
shared checkpoint folder, and cutting lineage safely."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "mentionflow", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name).master(master or "local[*]")
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster names a shared folder in ``spark.checkpoint.dir``; use it.

    Only local runs may do without: they get a scratch folder of their own.
    On a cluster an unset folder is an error, as its tasks share no other."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="mentionflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - no SparkContext (Connect): the conf is enough
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder, and read from there: what reads it
    several times takes only the columns it needs, and a lost executor costs no second run of ``df``."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that this library wrote (any Hadoop file system)."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # Connect: the folder's owner cleans it
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table. Every call lists its files anew: rows that were
    appended meanwhile are seen."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def remove_staged(df: DataFrame) -> None:
    """Delete the files that ``staged`` wrote for ``df``."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, folder)


def recommended_conf(input_bytes: int, executor_memory_gb: float = 16.0, cores_per_executor: int = 4,
                     executors: int = 1) -> dict:
    """Partition sizing for a run over ``input_bytes`` of text.

    Each shuffle partition should fit comfortably in a task's memory share
    (executor memory / cores, about a quarter of it for execution), so the
    initial shuffle partition count comes from the input volume. AQE then
    coalesces small partitions and splits skewed ones at run time."""
    per_task = executor_memory_gb * (1 << 30) / max(cores_per_executor, 1)
    target = int(min(max(per_task / 4, 64 << 20), 512 << 20))  # 64 MB .. 512 MB
    parts = max(executors * cores_per_executor * 2, int(input_bytes // target) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(min(target, 256 << 20)),
        "spark.sql.session.timeZone": "UTC",
    }
