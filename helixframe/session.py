"""Session defaults and the shared scratch folder.

Intermediate files (round-trip sinks, checkpoints) go under the folder the
cluster names in ``spark.checkpoint.dir``.  Only a local-mode session with no
such setting gets a private temporary folder (tests, laptops); a cluster
session without it is an error, because a machine-local folder is not visible
to other executors and does not survive their loss.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "helixframe", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults this library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("HELIX_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a private one only in
    local mode when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS/NFS) that every executor can reach")
    local = tempfile.mkdtemp(prefix="helixframe-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str = "run") -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/helixframe-scratch/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared folder (resolved first, so a
    session created elsewhere works too).  Used to cut lineage in loops;
    ``localCheckpoint`` is never used, since executors can be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python in Arrow batches of at most
    ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes, so a worker's memory does not
    grow with the rows of a task (the default, 10,000 rows, is for narrow
    ones).  A smaller setting of the session stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = (spark.conf.get(key) or "").removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


class Shared:
    """A broadcast value that may hold objects of this package's classes.

    A plain broadcast names their classes, so a worker without the package
    could not read it; here they travel by value, as the package's functions
    do.  A task reads the value once.
    """

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "read" not in self.__dict__:
            self.read = pickle.loads(self.sent.value)
        return self.read
