"""Session construction and cluster-safe helpers.

Everything here is configuration a Spark user would set by hand; the library never
hides a planner of its own. Helpers only read settings from the active session.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at 100 TB and cost nothing at sf0.01: adaptive execution re-plans
# joins once shuffle sizes are known (broadcast is chosen from *measured* sizes), coalesces
# tiny partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "opsmill",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("OPSMILL_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent (tests, a laptop) do we name one of our own: a new
    folder under the user's home of the default file system, which on a cluster is the
    shared one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        jvm = sc._jvm
        home = jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration()).getHomeDirectory().toString()
        configured = f"{home}/.opsmill-checkpoints/{uuid.uuid4().hex}"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, as ``spark-submit --py-files``
    would. The zip is a file of the driver alone; Spark serves it to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="opsmill-py-"), "opsmill.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for tables that a job writes and reads again;
    ``remove_scratch`` deletes all of them."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application wrote to ``scratch_path``, once nothing reads
    them any more. Checkpoints go with ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    jvm = spark._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of a side that holds at most ``max_rows`` rows, by measure.

    The rows are counted up to the bound (rule and price tables end there at once). A larger
    side gets no hint: the planner shuffles both sides, and adaptive execution still turns
    that into a broadcast if the measured bytes allow it.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Spread CPU-heavy per-row work (regexes over whole texts, tokenising) over the
    cluster's cores when the input yields fewer partitions than there are cores (a
    single-row-group file). On a large input the scan already has many more partitions
    than cores and this returns ``df`` unchanged - no extra shuffle at scale. Only the
    placement of rows differs; results are the same in either form."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
