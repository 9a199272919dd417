"""Tables that a stream writes batch by batch, and the manifest of what is finished.

A batch's rows lie in a folder of their own, named by run and batch. A run is a streaming query as its
checkpoint knows it: a kept checkpoint goes on with the run's numbers, a new one starts a run that
touches none of the old folders. Once the rows are complete, one small commit names their folders, by ``part`` (a day, an
hour, a key range) if the table has one, with rows and bytes. Readers read what the commits name, so they never see half a batch,
and a batch that is replayed after its commit is left as it is.

Commits are only added. One that lists folders under ``replaces`` takes them out of the table: retention,
compaction and moves are such commits, each whole or not there, and delete the folders after it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

COMMIT = "commit string, run string, batch_id bigint, part string, folder string, rows bigint, bytes bigint, replaces array<string>"
#: The run of rows written outside a stream.
NO_STREAM = "batch"


def current_run(spark: SparkSession) -> str:
    """Id of the streaming query whose batch this thread is working on."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or NO_STREAM


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    files, at = _files(spark, path)
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def commit(spark: SparkSession, path: str, run: str, batch_id: int, entries: list[tuple], replaces: list[str] = ()) -> None:
    """Adds one commit: entries (part, folder, rows, bytes), and the folders that it takes out of the table."""
    name = f"{time.time_ns():020d}-{run}-{batch_id}"
    rows = [dict(zip(("part", "folder", "rows", "bytes"), e, strict=True)) for e in entries]
    if replaces or not rows:
        rows.append({"replaces": list(replaces)})
    text = "\n".join(json.dumps({"commit": name, "run": run, "batch_id": batch_id, **r}) for r in rows)
    # a file that is there as a whole or not at all
    files, at = _files(spark, f"{path}/manifest/{name}.json")
    hidden = _files(spark, f"{path}/manifest/_{name}")[1]
    out = files.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.rename(hidden, at)


def live(spark: SparkSession, path: str) -> list[Row]:
    """Live folders of a table, one row per batch and part.

    They come to the driver, as file names do when Spark lists a table; compaction keeps them few.
    """
    if not exists(spark, f"{path}/manifest"):
        return []
    commits = spark.read.schema(COMMIT).json(f"{path}/manifest").collect()
    gone = {folder for c in commits for folder in c.replaces or ()}
    return [c for c in commits if c.folder is not None and c.folder not in gone]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """:func:`live` as a table: commit, run, batch_id, part, folder, rows, bytes."""
    return spark.createDataFrame(live(spark, path), COMMIT).drop("replaces")


def is_committed(spark: SparkSession, path: str, run: str, batch_id: int) -> bool:
    files, at = _files(spark, f"{path}/manifest/*-{run}-{batch_id}.json")
    return len(files.globStatus(at) or ()) > 0


def write_batch(
    df: DataFrame, batch_id: int, path: str, by: str | None = None, run: str | None = None, replaces: tuple[str, ...] = (),
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Stores a batch's rows once, and returns them as stored; ``by`` names a column of which every value gets a folder.

    Up to its commit a replay writes the batch anew; after it, the batch stays as it is. The same commit takes the
    folders in ``replaces`` out of the table. ``options`` are the file writer's.
    """
    spark = df.sparkSession
    run = run or current_run(spark)
    folder = f"{path}/data/run={run}/batch_id={batch_id}"
    stored = lambda: spark.read.schema(df.schema).parquet(folder)
    if not is_committed(spark, path, run, batch_id):
        writer = df.write.mode("overwrite").options(**options or {})
        (writer.partitionBy(by) if by else writer).parquet(folder)
        # one row per part of the batch comes to the driver
        part = (F.col(by) if by else F.lit(None)).cast("string").alias("part")
        parts = stored().groupBy(part).agg(F.count("*").alias("n")).collect()
        of = lambda part: folder if by is None else f"{folder}/{by}={part if part is not None else '__HIVE_DEFAULT_PARTITION__'}"
        commit(spark, path, run, batch_id, [(r.part, of(r.part), r.n, size(spark, of(r.part))) for r in parts], list(replaces))
        for gone in replaces:
            delete(spark, gone)
    return stored()


def read_batches(
    spark: SparkSession, path: str, schema: StructType | None = None, where: Callable[[Row], bool] = lambda entry: True
) -> DataFrame:
    """Rows of the table's live folders, or of those that ``where`` picks, with run and batch_id.

    Without any folder, ``schema`` gives the columns.
    """
    folders = [e.folder for e in live(spark, path) if where(e)]
    if not folders:
        if schema is None:
            raise ValueError(f"{path} has no finished batch, and no schema is given")
        return spark.createDataFrame([], schema).withColumns({"run": F.lit(""), "batch_id": F.lit(0).cast("bigint")})
    full = None
    if schema is not None:
        full = StructType([f for f in schema if f.name not in ("run", "batch_id")]).add("run", "string").add("batch_id", "long")
    return read_folders(spark, folders, full)


def read_folders(spark: SparkSession, folders: list[str], schema: StructType | None = None) -> DataFrame:
    """Rows of a table's folders with what their names say (run, batch_id, part); they may lie below several roots, as tiers do."""
    roots: dict[str, list[str]] = {}
    for folder in folders:
        roots.setdefault(folder.rpartition("/run=")[0], []).append(folder)
    out = None
    for root, below in sorted(roots.items()):
        reader = spark.read.option("basePath", root)
        rows = (reader if schema is None else reader.schema(schema)).parquet(*below)
        out = rows if out is None else out.unionByName(rows)
    return out


def relocate(spark: SparkSession, path: str, picked: list[Row], root: str, run: str, by: str, order: list[str], options: dict[str, str] | None = None) -> None:
    """Rewrites live folders into one below ``root``, a folder per value of ``by``; one commit exchanges them.

    Ended before the commit it leaves the table as it was (and a folder that nothing names), ended after it only the old files.
    """
    folders = [e.folder for e in picked]
    rows = read_folders(spark, folders).drop("run", "batch_id")
    number = time.time_ns()
    folder = f"{root}/run={run}/batch_id={number}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options or {}).partitionBy(by).parquet(folder)
    counted = spark.read.parquet(folder).groupBy(F.col(by).cast("string").alias("part")).agg(F.count("*").alias("n")).collect()
    if sum(r.n for r in counted) != sum(e.rows for e in picked):
        raise RuntimeError(f"{folder} does not hold the rows that the manifest names")
    entries = [(r.part, f"{folder}/{by}={r.part}", r.n, size(spark, f"{folder}/{by}={r.part}")) for r in counted]
    commit(spark, path, run, number, entries, folders)
    for e in picked:
        delete(spark, e.folder)


def take_out(spark: SparkSession, path: str, gone: Callable[[Row], bool], run: str) -> DataFrame:
    """Removes the live folders that ``gone`` picks, from the table and then from disk; returns what the manifest said of them."""
    picked = [e for e in live(spark, path) if gone(e)]
    if picked:
        commit(spark, path, run, len(picked), [], [e.folder for e in picked])
    for e in picked:
        delete(spark, e.folder)
    return spark.createDataFrame(picked, COMMIT).drop("replaces")


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], keep: int = 1) -> None:
    """Merges all batches but the ``keep`` newest of each run into one; the stream may run meanwhile.

    ``merge`` gets their rows and returns rows of the same columns that mean the same to the table's reader. The newest batch of a
    run is the only one that can be replayed, so ``keep`` is 1 at least.
    """
    entries = [e for e in live(spark, path) if e.part is None]
    newest = {e.run: max(x.batch_id for x in entries if x.run == e.run) for e in entries}
    old = [e for e in entries if e.run == "merged" or e.batch_id <= newest[e.run] - max(keep, 1)]
    if len(old) < 2:
        return
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[r.folder for r in old]).drop("run", "batch_id")
    number = time.time_ns()
    folder = f"{path}/data/run=merged/batch_id={number}"
    merge(rows).select(*rows.columns).write.parquet(folder)
    n = spark.read.parquet(folder).count()
    commit(spark, path, "merged", number, [(None, folder, n, size(spark, folder))], [r.folder for r in old])
    for r in old:
        delete(spark, r.folder)
