"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every evtide job assumes. UTC makes hour buckets, day boundaries and
# RFC 3339 output independent of the machine's zone.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of ``path`` in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def file_state(spark: SparkSession, path: str) -> tuple:
    """(name, size, time of change) of every file under ``path``: what a cache
    of the table's contents depends on."""
    fs, p = hadoop_path(spark, path)
    out = []
    if fs.exists(p):
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def build_session(master: str | None = None, app_name: str = "evtide",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with evtide's required settings.

    On a cluster pass ``master=None`` and let spark-submit decide; locally pass
    ``local[N]``. The UI stays off: nothing here needs a web server.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    # checkpoint files go when nothing refers to them any more
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster's shared storage). Where it
    is unset, a local run (driver and executors in one process) gets a fresh
    scratch folder, registered with the context since the setting itself cannot
    change at run time; on a cluster that is an error, since each executor
    would write to its own disk.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    current = sc.getCheckpointDir()
    if current:
        return current
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="evtide-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder, in the
    application's own folder there, which goes when the application ends."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/evtide-{spark.sparkContext.applicationId}"
    if base not in _OWN_FOLDERS:
        fs, p = hadoop_path(spark, base)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _OWN_FOLDERS.add(base)
    return f"{base}/{name}-{os.urandom(6).hex()}"


_OWN_FOLDERS: set[str] = set()
