"""Session helpers.

``get_session`` builds a local session for tests and benchmarks with the
settings every operator relies on: UTC session time zone, ANSI mode on
(so invalid casts must go through ``try_*`` functions), adaptive query
execution with partition coalescing and skew-join splitting, and no UI.
On a cluster, pass the existing session around instead; nothing here is
required there except a checkpoint directory (see ``checkpoint_dir``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "vellum",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """A local session with the settings the operators rely on (see module doc)."""
    cpus = os.environ.get("BENCH_CPUS") or "8"
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "4g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    quiet_query_context_log()
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose
    driver runs every task (``local``) may get a scratch folder here; on a
    cluster executors would each write to their own disk, so an unset folder
    is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        conf_dir = tempfile.mkdtemp(prefix="vellum-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def quiet_query_context_log() -> None:
    """Analysis errors that operators catch on purpose (a bad rule or KPI
    becomes a status row) are otherwise logged with a full JVM trace."""
    import logging
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)


def recommended_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                     max_shuffle_partitions: int = 50_000) -> dict:
    """Settings for a large cluster: scan splits of ``target_partition_bytes``,
    an initial shuffle width that keeps partitions near that size (AQE then
    coalesces small ones and splits skewed ones), at least two waves of tasks,
    and at most ``max_shuffle_partitions`` (map outputs grow as maps x reducers)."""
    shuffle = min(max_shuffle_partitions, max(2 * total_cores, int(input_bytes // target_partition_bytes) or 1))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def ship_package(spark: SparkSession) -> None:
    """Make ``vellum`` importable on the executors (once per session).

    Pandas-based steps (``applyInPandas``, ``mapInPandas``, pandas UDFs)
    unpickle functions defined in this package, so the Python workers need
    it on their path: the package is zipped on the driver and shipped with
    ``addPyFile`` (``addArtifacts`` on a remote session)."""
    key = "vellum.package.shipped"
    if spark.conf.get(key, None) == "true":
        return
    import zipfile

    import vellum
    root = os.path.dirname(os.path.dirname(os.path.abspath(vellum.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="vellum-pkg-"), "vellum.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "vellum")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    try:
        spark.sparkContext.addPyFile(path)
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext
        spark.addArtifacts(path, pyfile=True)
    spark.conf.set(key, "true")
