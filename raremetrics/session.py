"""Session helpers: one place for the settings every job here relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that the semantics depend on (UTC wall clock, ANSI errors on bad casts)
# plus adaptive execution so shuffle partition counts and join strategies are
# re-planned from runtime sizes.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "raremetrics",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks. On a cluster use the cluster's session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(CORE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Python tasks unpickle functions by module name, so workers need the package wherever
    the driver was started and whatever their own path is.
    """
    sc = spark.sparkContext
    if getattr(sc, "_raremetrics_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="raremetrics-zip-")
    archive = os.path.join(folder, "raremetrics_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._raremetrics_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant location and is used as is;
    without it a cluster session is refused, as machines would not see each other's
    files.  Only a local master (tests) gets a scratch folder of its own.
    """
    ship_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="raremetrics-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for materialised intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def spread(df, per_core: int = 2):
    """``df`` checkpointed in at least a few partitions per core, for CPU-bound passes.

    A frame that has more already keeps them, so partitions do not grow with the data."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    least = compute_partitions(df.sparkSession, per_core)
    return kept if kept.rdd.getNumPartitions() >= least else kept.repartition(least).checkpoint(eager=True)


def compute_partitions(spark: SparkSession, per_core: int = 2) -> int:
    """Partition count for CPU-bound passes (IRLS, tree training): a few tasks per core.

    Byte-based coalescing would put a small-but-compute-heavy model frame in one task;
    row-wise numeric work wants every core busy regardless of bytes."""
    return max(1, spark.sparkContext.defaultParallelism * per_core)
