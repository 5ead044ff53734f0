"""Session construction and shared-storage helpers.

A cluster names its shared, fault-tolerant folder in ``spark.checkpoint.dir``.
Everything that must outlive a task (lineage cuts, scratch tables, stage
outputs of the test harness) goes below that folder.  Only when the setting is
absent -- local tests, notebooks -- do we pick a local folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Configuration we rely on.  AQE re-plans joins from measured sizes (this is the
# "checked size" behind most broadcasts), coalesces small shuffle partitions and
# splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state off-heap in RocksDB (large keyed state, fast commits)
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "blocklens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app_name)
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
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster configured, if any."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        # getCheckpointDir returns <dir>/<uuid>; scratch goes next to it.
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    return conf_dir or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating a local one only when unset."""
    root = checkpoint_root(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="blocklens-ckpt-")
        spark.sparkContext.setCheckpointDir(local)
        root = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def shared_root(spark: SparkSession) -> str:
    """The configured shared folder itself, the same for every application; on
    a local master without one, the session's own folder."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return configured or ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a scratch table in the shared folder and read back:
    a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a written frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``blocklens`` importable by the Python workers (once per app).

    The package sources are zipped in memory, written to the shared
    checkpoint folder and registered with ``addPyFile``; Spark distributes
    the archive to every executor and puts it on the workers' path.  Needed
    for the steps that run Python on executors (tree growth and scoring,
    Drain, the text model) when the package is not installed there.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in sorted(os.walk(pkg_dir)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, base))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    target = os.path.join(ensure_checkpoint_dir(spark), "pyfiles", f"blocklens-{digest}.zip")
    jvm = sc._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
