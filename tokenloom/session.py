"""Session creation and lineage cutting.

Library code never creates its own scratch space on a cluster: the shared
checkpoint folder is read from ``spark.checkpoint.dir``.  Only a local-mode
session without that setting (tests, laptops) gets a fresh temporary folder.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "tokenloom",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _package_zip() -> bytes:
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    return buf.getvalue()


def write_shared_bytes(spark: SparkSession, target: str, data: bytes) -> None:
    """Write bytes to any Hadoop-supported path (HDFS, S3A, ABFS, file:) from the driver."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete_path(spark: SparkSession, target: str) -> None:
    """Delete a folder that this package wrote (a missing one is fine)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Ship the package to the Python workers; a failure is reported, not raised
    (workers that already import the package from their path keep working)."""
    try:
        _ship_package(spark)
    except Exception as ex:  # noqa: BLE001
        import warnings
        warnings.warn(f"tokenloom: could not ship the package to executors: {ex}")


def _ship_package(spark: SparkSession) -> None:
    """Make ``tokenloom`` importable in every Python worker (the ``--py-files`` route).

    Arrow-batched operators run module functions on the executors.  The package is
    zipped in memory once per application; a local session adds it from a local
    file, a cluster session writes it to the shared checkpoint folder first (never a
    machine-local folder) and adds it from there.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect session: ship through the artifact API instead
        key = f"connect:{id(spark)}"
        if key not in _SHIPPED:
            target = os.path.join(tempfile.mkdtemp(prefix="tokenloom-pyfiles-"), "tokenloom.zip")
            with open(target, "wb") as fh:
                fh.write(_package_zip())
            spark.addArtifacts(target, pyfile=True)
            _SHIPPED.add(key)
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    data = _package_zip()
    name = f"tokenloom-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    if _is_local(spark):
        target = os.path.join(tempfile.mkdtemp(prefix="tokenloom-pyfiles-"), name)
        with open(target, "wb") as fh:
            fh.write(data)
    else:
        target = f"{checkpoint_dir(spark).rstrip('/')}/pyfiles/{name}"
        write_shared_bytes(spark, target, data)
    sc.addPyFile(target)
    _SHIPPED.add(app)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, set from ``spark.checkpoint.dir``.

    On a cluster the setting must exist; a local session without it gets a
    fresh temporary folder (the test situation).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set")
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a shared "
                "checkpoint folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tokenloom-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scale_conf(input_bytes: float, executor_cores: int, n_executors: int,
               executor_memory_gb: float = 16.0, target_partition_mb: int = 256) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    * scan splits of ``target_partition_mb`` (bounded by per-core memory / 4);
    * shuffle partitions so that each holds about one split of data, at least
      two waves of the available cores (AQE then coalesces small ones and splits
      skewed ones at runtime).
    """
    cores = max(1, executor_cores * n_executors)
    per_core_mb = executor_memory_gb * 1024 / max(1, executor_cores)
    split_mb = int(max(32, min(target_partition_mb, per_core_mb / 4)))
    shuffle = max(2 * cores, int(input_bytes / (split_mb * 1024 * 1024)))
    return {
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{split_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * split_mb}m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16m",
    }
