"""Session construction and cluster-facing settings.

On a cluster the session already exists and carries its own settings; the
helpers here only fill in what is missing, so they never override the
operator's configuration.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library relies on. AQE re-plans joins and
# coalesces shuffle partitions from runtime statistics; its skew-join rule
# splits an oversized shuffle partition (one key holding a large share of
# the rows) into several tasks.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "skylane", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and benchmarks (UI off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
         # remove checkpoint files of frames that are no longer referenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in {**RECOMMENDED, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_recommended(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings above where the session has none."""
    for k, v in RECOMMENDED.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``; only when it is unset (tests,
    local runs) is ``fallback`` installed. Iterative jobs (boosted trees)
    cut their lineage there, so a lost executor costs a bounded recompute.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set and no fallback was given")
        sc.setCheckpointDir(fallback)
        d = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for tables derived on the way.

    In the cluster's checkpoint folder; a local session without one (tests)
    gets a temporary folder, any other master must name a folder."""
    local = spark.sparkContext.master.split("[")[0] == "local"
    fallback = tempfile.mkdtemp(prefix="skylane-shared-") if local and not spark.sparkContext.getCheckpointDir() else None
    return f"{checkpoint_dir(spark, fallback).rstrip('/')}/skylane/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Compute ``df`` once and cut its lineage for the jobs that reuse it.

    With a cluster checkpoint folder (``spark.checkpoint.dir``) the rows
    are written there (reliable: survives executor loss without
    recomputing the upstream plan); otherwise they are persisted in
    executor memory and disk. Used for small intermediate frames that
    several follow-up jobs read (value counts, design tables), so the big
    source scan runs once.
    """
    from pyspark import StorageLevel
    try:
        sc = df.sparkSession.sparkContext
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if d and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        reliable = bool(sc.getCheckpointDir())
    except Exception:          # no JVM context (remote session): fall back to persist
        reliable = False
    if reliable:
        return df.checkpoint(eager=True)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out
