"""The finished batches of a table as a stream: a source with offsets.

A table written by :mod:`convoy.sources.batches` is an archive that grows by commits. This source follows it: an offset is the name of
the last commit read, so a micro-batch is the rows of whole finished batches, the same ones when it is replayed, and a
batch that its writer replays is not read twice. With ``batchesPerTrigger`` a micro-batch takes so many commits at most;
Spark does not tell a source in Python where it stands, so the limit needs a file of the stream's own (``progress``), in
which the end of each planned micro-batch is noted. Folders that compaction or retention took out before they were read are skipped, so keep
what a stream still follows out of both.

The driver reads file names and the manifest, tasks read whole files, with pyarrow's file systems: a local or shared
path, HDFS or an object store that it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "finished_batches"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    files, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else path.replace("file:", "file://", 1))
    return files, at


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FinishedBatchReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.most = options["path"], int(options.get("batchespertrigger", 0))
        self.schema, self.progress = schema, options.get("progress")
        self.position = self._noted() if self.most and self.progress else None

    def _noted(self) -> str:
        files, at = _at(self.progress)
        if files.get_file_info(at).type == fs.FileType.NotFound:
            return ""
        with files.open_input_stream(at) as f:
            return f.read().decode()

    def _note(self, name: str) -> None:
        self.position = name
        files, at = _at(self.progress)
        files.create_dir(at.rsplit("/", 1)[0])
        with files.open_output_stream(at) as f:
            f.write(name.encode())

    def _names(self) -> list[str]:
        """Commits in the order in which they were made."""
        files, at = _at(f"{self.root}/manifest")
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("_"))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = self._names()
        if self.position is None:
            return {"after": names[-1] if names else ""}
        new = [n for n in names if n > self.position][: self.most]
        return {"after": new[-1] if new else self.position}

    def partitions(self, start: dict, end: dict) -> list[File]:
        if self.position is not None:
            self._note(end["after"])
        files, out = _at(self.root)[0], []
        for name in self._names():
            if start["after"] < name <= end["after"]:
                with files.open_input_stream(_at(f"{self.root}/manifest/{name}")[1]) as f:
                    entries = [json.loads(line) for line in f.read().decode().splitlines()]
                if any(e.get("replaces") for e in entries):
                    continue  # rewritten rows (merged, moved, put together) have been read where they came from
                for e in entries:
                    if e.get("folder"):
                        here = files.get_file_info(fs.FileSelector(_at(e["folder"])[1], allow_not_found=True, recursive=True))
                        out += [File(f.path) for f in here if f.is_file and not f.base_name.startswith(("_", "."))]
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        with pq.ParquetFile(_at(self.root)[0].open_input_file(partition.path)) as file:
            for batch in file.iter_batches(batch_size=10_000, columns=target.names):
                table = pa.Table.from_batches([batch]).select(target.names)
                yield from table.cast(target).to_batches()


class FinishedBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["rows"]

    def streamReader(self, schema: StructType) -> FinishedBatchReader:
        return FinishedBatchReader({k.lower(): v for k, v in self.options.items()}, schema)


def read_finished(
    spark: SparkSession, path: str, schema: str | StructType, batches_per_trigger: int = 0, progress: str | None = None
) -> DataFrame:
    """A stream of the rows of a table's finished batches, from its first one on; a limit needs a ``progress`` file beside the checkpoint."""
    if batches_per_trigger and not progress:
        raise ValueError("a limit per trigger needs a progress file")
    spark.dataSource.register(FinishedBatches)
    if isinstance(schema, StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    stream = spark.readStream.format(NAME).option("rows", schema).option("path", path)
    if progress:
        stream = stream.option("progress", progress)
    return stream.option("batchesPerTrigger", batches_per_trigger).load()
