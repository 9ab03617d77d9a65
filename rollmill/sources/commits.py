"""Tables that several writers append to at once: data folders, and a log of numbered commits that are made only if they are not there.

A writer looks at the last version, decides by it what is new, writes that to a folder of its own and
tries to put the next commit. If another writer was first, it takes its folder away, looks at the
new version and decides again, so a decision always holds for the version it is committed on.
Readers see the folders that commits name; what a failed or killed job wrote is in none.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollmill.sources.shared import checkpointed

TRIES = 30


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file, whole; false if it was there.

    On a local file system the file is written aside and linked to its name, which only one can do;
    on others the store's own creation without overwriting decides, which HDFS does for one writer only.
    """
    files, where = _hadoop(spark, path)
    files.mkdirs(where.getParent())
    jvm = spark._jvm
    if files.getScheme() == "file":
        nio = jvm.java.nio.file
        target = nio.Paths.get(files.makeQualified(where).toUri())
        aside = target.resolveSibling(f".{target.getFileName().toString()}-{uuid.uuid4().hex}")
        nio.Files.write(aside, bytearray(text.encode()), spark.sparkContext._gateway.new_array(nio.OpenOption, 0))
        try:
            nio.Files.createLink(target, aside)
            return True
        except Exception as taken:
            if "FileAlreadyExists" not in str(taken):
                raise
            return False
        finally:
            nio.Files.deleteIfExists(aside)
    try:
        out = files.create(where, False)
    except Exception as taken:
        if "AlreadyExists" not in str(taken) and "already exists" not in str(taken):
            raise
        return False
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str | None:
    files, where = _hadoop(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden ones; none if it is not there."""
    files, where = _hadoop(spark, path)
    return sorted(n for x in files.listStatus(where) if not (n := x.getPath().getName()).startswith((".", "_"))) if files.exists(where) else []


def snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The last version and its rows; 0 and none for a table that is not there."""
    versions = names(spark, f"{path}/log")
    folders = [json.loads(text_of(spark, f"{path}/log/{v}"))["folder"] for v in versions]
    return len(versions), spark.read.parquet(*(f"{path}/data/{f}" for f in folders)) if folders else None


def append(path: str, rows: DataFrame, admit: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
    """Appends what ``admit`` (saved rows or none, rows) lets in, and says how many; what it raises is the writer's failure."""
    spark, path = rows.sparkSession, path.rstrip("/")
    rows = checkpointed(rows)
    for k in range(TRIES):
        version, saved = snapshot(spark, path)
        fresh = checkpointed(admit(saved, rows))
        n = fresh.count()
        if not n and version:
            return 0
        folder = uuid.uuid4().hex
        done = False
        try:
            fresh.write.parquet(f"{path}/data/{folder}")
            done = put_if_absent(spark, f"{path}/log/{version + 1:010d}", json.dumps({"folder": folder, "rows": n}))
        finally:
            if not done:
                files, where = _hadoop(spark, f"{path}/data/{folder}")
                files.delete(where, True)
        if done:
            return n
        time.sleep(random.uniform(0, 0.05 * (k + 1)))
    raise RuntimeError(f"{TRIES} other writers came first: {path}")
