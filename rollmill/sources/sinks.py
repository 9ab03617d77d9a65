"""Writers: partitioned tables, JSON lines with digests, write-once tables, reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.operators import prompts
from rollmill.operators.common import empty, unique
from rollmill.operators.integrity import changed_audits, overlapping
from rollmill.sources import commits
from rollmill.sources.shared import checkpointed


def save_trajectories(rows: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """A Parquet table by split; rows that an existing table has under another evaluation are refused."""
    if existing is not None:
        both = rows.alias("a").join(existing.alias("b"), "trajectory_id").where("not (a.task_id <=> b.task_id and a.policy_version <=> b.policy_version)")
        empty(both.select("trajectory_id"), "trajectory of another evaluation")
    rows.write.mode("append").partitionBy("split").option("compression", "zstd").parquet(path)


def append_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True, separators=(",", ":")),)], "value string").write.mode("append").text(path)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Puts a written folder in the place of ``path``; what was there goes only once the new one is in place."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    target, old = make(path), make(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(target)
    if there and not files.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not files.rename(make(new), target):
        if there:
            files.rename(old, target)
        raise OSError(f"cannot put {new} in place")
    if there:
        files.delete(old, True)


def _file_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    n, digest = 0, hashlib.sha256()
    for batch in batches:
        for line in batch.column(0).to_pylist():
            digest.update(f"{line or ''}\n".encode())
            n += 1
    yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "sha256": [digest.hexdigest()]})


def write_lines(rows: DataFrame, path: str, value: str = "value", one_file: bool = True) -> tuple[int, str]:
    """Lines, each ended by one line feed whatever ended it before, and (count, SHA-256).

    One file, in the rows' order, and its SHA-256: a SHA-256 is one chain, so one task writes and
    one reads. For more than a task can take, ``one_file=False`` keeps the partitions and gives the
    SHA-256 over the files' SHA-256s in their order. A job that fails leaves an old file as it was.
    """
    spark = rows.sparkSession
    lines = rows.select(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+$", "").alias("value"))
    lines = checkpointed(lines.coalesce(1) if one_file else lines)
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    lines.write.option("lineSep", "\n").text(fresh)
    parts = [r for r in lines.mapInArrow(_file_digest, "part long, n long, sha256 string").orderBy("part").toLocalIterator() if r["n"] or one_file]
    replace_folder(spark, fresh, path)
    count = sum(r["n"] for r in parts)
    if one_file:
        return count, parts[0]["sha256"] if parts else hashlib.sha256().hexdigest()
    return count, hashlib.sha256("".join(r["sha256"] for r in parts).encode()).hexdigest()


def write_split(rows: DataFrame, path: str, by: str = "split") -> None:
    """Parquet, zstd, a folder for each value, in one pass."""
    rows.write.mode("overwrite").partitionBy(by).option("compression", "zstd").parquet(path)


def route(rows: DataFrame, state, path: str) -> None:
    """Accepted, rejected and pending rows to folders of their own."""
    write_split(rows.withColumn("state", state), path, "state")


def content_name(rows: DataFrame) -> str:
    """A name for a table's content, whatever the order of its rows: their number and sums of pieces of their SHA-256s, so that no rows cancel out."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    piece = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    n, *sums = rows.select(row.alias("h")).agg(F.count(F.lit(1)), *[piece(k) for k in range(4)]).first()
    return f"{n}-" + hashlib.sha256(",".join(str(x or 0) for x in sums).encode()).hexdigest()


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as missing:  # Spark's own error for a path that is not there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def write_once(rows: DataFrame, root: str, keys: list[str]) -> str:
    """A table under the name of its content; equal content is left as it is, and a table is never replaced. Repeated keys fail."""
    spark = rows.sparkSession
    empty(unique(rows, keys), "a key of several rows")
    path = f"{root.rstrip('/')}/{content_name(rows)}"
    have = _read_if_there(spark, path)
    if have is None:
        rows.write.parquet(path)
        return path
    empty(have.exceptAll(rows.select(*have.columns)).select(*keys), "a table of this name has other rows")
    empty(rows.select(*have.columns).exceptAll(have).select(*keys), "a table of this name lacks rows")
    return path


def save_audits(reports: DataFrame, path: str, key: str = "uid", report: str = "report") -> int:
    """Appends the reports whose key is new, and says how many; a saved key with another report fails, an equal one is left.

    Of two writers of one key at once, one is first, and the other decides by what the first has saved (see ``commits``).
    """
    empty(unique(reports, [key]), "a key of several reports")

    def new(saved: DataFrame | None, rows: DataFrame) -> DataFrame:
        if saved is None:
            return rows
        empty(changed_audits(saved, rows, key, report), "a saved report has changed")
        return rows.join(saved.select(key), key, "left_anti")

    return commits.append(path, reports.select(key, report), new)


def read_audits(spark: SparkSession, path: str) -> DataFrame | None:
    """All saved reports; none if nothing was saved."""
    return commits.snapshot(spark, path.rstrip("/"))[1]


def prompt_report(rows: DataFrame, expected: DataFrame, path: str) -> bool:
    """Writes the report over inspected prompts beside their rows; an existing report is never overwritten. Says whether all passed."""
    summary = checkpointed(prompts.report(rows, expected))
    summary.write.mode("error").json(f"{path.rstrip('/')}/summary")
    rows.write.mode("error").json(f"{path.rstrip('/')}/rows")
    return bool(summary.first()["all_requested_samples_passed"])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True)


def report(metrics: dict[str, float]) -> str:
    """A Markdown table of six-digit figures."""
    return "\n".join(["| metric | value |", "| --- | --- |", *(f"| {k} | {v:.6f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in metrics.items())])


def split_bundles(parts: dict[str, DataFrame], path: str, key: str | None = None, subsets: tuple[str, ...] = ()) -> None:
    """Tagged frames as one table of bundles; with a key, bundles that are no subsets of others must share none."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("bundle", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if key is not None:
        empty(overlapping(out.where(~F.col("bundle").isin(*subsets)), key, "bundle"), "a key of two bundles")
    write_split(out, path, "bundle")
