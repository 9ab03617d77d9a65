"""Tar archives as a data source: the headers are walked once for an index, the members are read in parallel by their offsets."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of members that one task reads, unless one member is larger.
TASK_BYTES = 32 << 20


def unsafe(path: str) -> bool:
    """Whether a member's name could lead out of its folder."""
    return path.startswith("/") or "\\" in path or ".." in path.split("/")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def reachable(uri: str) -> bool:
    """Whether tasks can open the file themselves; a store that only Spark's readers know is not."""
    try:
        system, path = opened(uri)
        return system.get_file_info(path).type == pafs.FileType.File
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False


@dataclass
class Members(InputPartition):
    """Names, offsets and sizes of members that one task reads."""

    members: list[tuple[str, int, int]]

    def __post_init__(self):
        super().__init__(len(self.members))


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.limit, self.task_bytes = int(options.get("limit", 32 << 20)), int(options.get("taskBytes", TASK_BYTES))

    def index(self) -> Iterator[tuple[str, int, int]]:
        """Members that are wanted; an unsafe name, a link or a member over the limit fails before any is read."""
        system, path = opened(self.path)
        with system.open_input_file(path) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
            for item in tar:
                if unsafe(item.name) or item.issym() or item.islnk():
                    raise ValueError(f"unsafe member: {item.name}")
                if item.isfile() and item.name.endswith(self.suffix):
                    if item.size > self.limit:
                        raise ValueError(f"member too large: {item.name}")
                    if item.issparse():
                        raise ValueError(f"sparse member: {item.name}")
                    yield item.name, item.offset_data, item.size

    def partitions(self) -> list[Members]:
        out, held, size = [], [], 0
        for member in self.index():
            if held and size + member[2] > self.task_bytes:
                out.append(Members(held))
                held, size = [], 0
            held.append(member)
            size += member[2]
        return [*out, *([Members(held)] if held else [])] or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.path)
        with system.open_input_file(path) as raw:
            for name, offset, size in partition.members:
                yield pa.RecordBatch.from_pydict({"path": [name], "text": [raw.read_at(size, offset).decode()]})


class TarSource(DataSource):
    """``spark.read.format("rollmill_tar")``: path and text of the members; options path, suffix, limit and taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "rollmill_tar"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options)


def read_tar(spark: SparkSession, source: str, limit: int, suffix: str = ".json", task_bytes: int = TASK_BYTES) -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.read.format("rollmill_tar").option("suffix", suffix).option("limit", limit).option("taskBytes", task_bytes).load(source)
