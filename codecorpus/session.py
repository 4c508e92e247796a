"""Session helpers.

Library code never builds its own session: every operator takes DataFrames
or a ``SparkSession`` from the caller. ``local_session`` exists for tests,
``bench.py`` and ad-hoc runs on one machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale as much as locally: AQE re-plans joins and
# coalesces/splits shuffle partitions at run time, skew join splits hot keys.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Size-checked broadcast: only sides Catalyst can prove below 32 MB.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "codecorpus") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder
    and is used as is; a cluster session without it is an error. Only a
    local-mode session without it (tests, one-machine runs) gets a fresh
    scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return conf_dir or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster[..] is a cluster
        # a folder on one machine is useless to executors elsewhere
        raise ValueError("set spark.checkpoint.dir to a folder on the cluster's shared file system")
    scratch = tempfile.mkdtemp(prefix="codecorpus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, remembered until
    ``drop_scratch``. Results read such folders lazily, so they live as long
    as the results do."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process has made and the saved
    checkpoints of its session, when their results are consumed; how many
    scratch folders there were."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    found = len(_SCRATCH)
    while _SCRATCH:
        path = hadoop(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
    folder = hadoop(ensure_checkpoint_dir(spark))
    store = folder.getFileSystem(conf)
    for f in store.listStatus(folder):
        if f.getPath().getName().startswith("rdd-"):
            store.delete(f.getPath(), True)
    return found
