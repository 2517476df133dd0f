"""Gives executors this package, for the few operators whose tasks run Python."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import evtide
from evtide.session import hadoop_path, scratch_path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Hadoop, whatever store ``path`` is in."""
    fs, target = hadoop_path(spark, path)
    out = fs.create(target, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i:i + (1 << 20)]))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that tasks can
    import it wherever the driver was started."""
    sc = spark.sparkContext
    name = f"evtide-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    root = Path(evtide.__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{scratch_path(spark, 'package')}/{name}"
    write_bytes(spark, path, data.getvalue())
    sc.addPyFile(path)
