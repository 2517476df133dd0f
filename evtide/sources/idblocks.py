"""Blocks of dense ids, reserved in a folder that batch and stream jobs share.

A block is a folder named by its first id and holds one empty file named by its end
and its owner. It is made under another name and renamed to its place without
overwriting, which succeeds for one of several jobs only; the others go on to the next
id. So ids come from the folder alone: nobody asks the fact table for its largest id.

A job that may be repeated passes an owner (stream and batch number, say) and gets the
block again that it has: what it meant to take is noted before the rename, and the note
counts if the block is there and is its own. Old blocks are pruned; the newest
``KEEP`` stay.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from evtide.session import delete_path, hadoop_path, path_exists
from evtide.sources import sinks

KEEP = 100
_DIGITS = 19


def _blocks(spark: SparkSession, path: str) -> list[str]:
    fs, p = hadoop_path(spark, f"{path}/blocks")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.isdigit())


def _content(spark: SparkSession, path: str, block: str) -> tuple[int, str]:
    """(last id, owner) of a block."""
    fs, p = hadoop_path(spark, f"{path}/blocks/{block}")
    for f in fs.listStatus(p):
        end, _, owner = f.getPath().getName().partition("~")
        if end.isdigit():
            return int(end), owner
    raise ValueError(f"block {block} of {path} is empty")


def _take(spark: SparkSession, path: str, first: int, last: int, owner: str) -> bool:
    """Make the block, unless another job has made one that begins there."""
    made = f"{path}/blocks/.new-{uuid.uuid4().hex}"
    fs, file = hadoop_path(spark, f"{made}/{last}~{owner}")
    fs.create(file, True).close()
    jvm, target = spark._jvm, f"{path}/blocks/{first:0{_DIGITS}d}"
    _, src = hadoop_path(spark, made)
    _, dst = hadoop_path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        src.toUri(), spark._jsc.hadoopConfiguration()) if src.toUri().getScheme() else \
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(
        jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, dst, never)         # fails where there is one already
        return True
    except Exception:
        if not path_exists(spark, target):
            raise
        delete_path(spark, made)
        return False


def high_water(spark: SparkSession, path: str, start: int = 0) -> int:
    """The largest id handed out, ``start`` if none was."""
    found = _blocks(spark, path)
    return max(_content(spark, path, found[-1])[0], start) if found else start


def reserve(spark: SparkSession, path: str, n: int, owner: str | None = None,
            start: int = 0) -> int:
    """Reserve ids ``base + 1 .. base + n``; returns ``base``. The first block
    ever follows ``start``. A repeated owner gets its block again, and a new one
    only if it now needs another number of ids."""
    path, note = path.rstrip("/"), None
    if owner is not None:
        if "/" in owner:
            raise ValueError("an owner is a file name")
        note = f"{path}/owners/{owner}"
        if path_exists(spark, note):
            had = json.loads(sinks.read_note(spark, note))
            block = f"{had['base'] + 1:0{_DIGITS}d}"
            if had["n"] == n and (not n or (
                    path_exists(spark, f"{path}/blocks/{block}")
                    and _content(spark, path, block) == (had["base"] + n, owner))):
                return had["base"]
    while True:
        base = high_water(spark, path, start)
        if note:
            delete_path(spark, note)
            sinks.write_note(spark, note, {"base": base, "n": n})
        if not n or _take(spark, path, base + 1, base + n, owner or ""):
            break
    for old in _blocks(spark, path)[:-KEEP]:
        _, who = _content(spark, path, old)
        delete_path(spark, f"{path}/blocks/{old}")
        if who:
            delete_path(spark, f"{path}/owners/{who}")
    return base
