"""Session helpers: a tuned session for tests / bench, and the shared folder.

Library functions never change session settings; they take DataFrames.  The
settings below are the ones the plans are designed around (AQE re-plans
joins from runtime sizes, coalesces small shuffle partitions and splits
skewed ones).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: settings the plans rely on; a cluster session should carry them too
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # no broadcast from plan-time estimates (a compressed Parquet size can
    # under-count a dimension many times); AQE broadcasts a join side only
    # after its shuffle stage *measured* it below this size, and otherwise
    # keeps the sort-merge join, splitting skewed partitions
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


#: sizing for a large cluster (applied by the command line when unset): many
#: initial shuffle partitions, which AQE coalesces to ~128 MB each, so a
#: multi-terabyte shuffle never puts more than a few hundred MB in one task;
#: 256 MB scan splits keep the Parquet read at a few hundred thousand tasks
#: for 100 TB while each split still fits an executor core comfortably
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "adlift", **conf) -> SparkSession:
    """A session for tests and the benchmark (UI off, checkpoint folder set
    only when the session has none)."""
    b = SparkSession.builder.master(master).appName(app)
    settings = {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("ADLIFT_DRIVER_MEMORY", "8g"),
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    When it is unset, a local session (tests, bench) gets a fresh folder under
    the system temp dir; a cluster session must name one, since a
    machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if d:
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    d = tempfile.mkdtemp(prefix="adlift-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name under the shared folder (not created)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
