"""Dead letters stored by the mapping that judged them, so that an activated version re-reads only what it can change."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.operators.mapping import mapping_dict
from convoy.operators.routing import route
from convoy.schemas import OEM_PATTERN
from convoy.sources.batches import live, read_folders, write_batch
from convoy.sources.ndjson import classify_lines

#: Part of the letters whose vendor no mapping can name.
NO_VENDOR = "none"


def _versions(mappings: DataFrame | dict) -> dict[str, int]:
    return {oem: int(doc.get("version") or 1) for oem, doc in mapping_dict(mappings).items()}


def store_rejects(
    rejected: DataFrame, batch_id: int, path: str, mappings: DataFrame | dict, raw: tuple[str, ...] = ("oem", "line", "received_at"),
    run: str | None = None, replaces: tuple[str, ...] = (),
) -> DataFrame:
    """Stores the ``raw`` columns and the reason of rejected rows, a folder per vendor and version (``A~1``; 0 without a mapping).

    ``oem`` and ``line`` must be among ``raw``: a letter is read again from its whole line.
    """
    versions = _versions(mappings)
    version = F.lit(0)
    if versions:
        known = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
        version = F.coalesce(F.try_element_at(known, F.col("oem")), version)
    judged = F.when(F.col("oem").rlike(OEM_PATTERN), F.concat("oem", F.lit("~"), version.cast("string"))).otherwise(F.lit(NO_VENDOR))
    return write_batch(rejected.select(*raw, "reason", judged.alias("judged")), batch_id, path, "judged", run, replaces)


def replay_changed(
    spark: SparkSession, rejects: str, accepted: str, mappings: DataFrame | dict, vehicle: DataFrame, fleet: DataFrame
) -> DataFrame:
    """Routes again the letters of vendors whose active version is not the one that judged them.

    Only those vendors' folders are read, whole. Rows that pass go to the table ``accepted``, the others back to
    ``rejects`` under the new version, in a commit that takes the old folders out. The batch is named after the folders it
    reads, so a replay that broke off is finished by the next one, and without an activation a second one does nothing.
    Returns what was read: part and rows.
    """
    versions = _versions(mappings)

    def stale(part: str | None) -> bool:
        oem, _, version = (part or NO_VENDOR).rpartition("~")
        return bool(oem) and versions.get(oem, 0) != int(version)

    picked = [e for e in live(spark, rejects) if stale(e.part)]
    if picked:
        folders = tuple(sorted(e.folder for e in picked))
        number = int(hashlib.sha256("\n".join(folders).encode()).hexdigest()[:15], 16)
        letters = read_folders(spark, list(folders)).drop("run", "batch_id", "judged", "reason")
        routed = route(classify_lines(letters), mappings, vehicle, fleet).drop("payload")
        done = write_batch(routed, number, f"{rejects}/replayed", run="replay")  # routed once, read for both sides
        write_batch(done.filter(F.col("reason").isNull()).drop("reason"), number, accepted, run="replay")
        store_rejects(done.filter(F.col("reason").isNotNull()), number, rejects, mappings, tuple(letters.columns), "replay", folders)
    return spark.createDataFrame([(e.part, e.rows) for e in picked], "part string, rows bigint")
