"""Versioned vendor mappings: registry jobs and their driver-side form.

The registry itself is the only table an operator may read on the driver: one small document per
vendor and version.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from convoy.operators.numbering import numbered
from convoy.schemas import (
    MAPPING_SCHEMA,
    OEM_PATTERN,
    OPTIONAL_FIELDS,
    REQUIRED_FIELDS,
    TS_FORMATS,
    UNITS,
    VENDOR_MAPPINGS,
)
from convoy.functions.fields import as_text, quoted


def vendor_registry(
    spark: SparkSession, active: tuple[str, ...] = tuple(VENDOR_MAPPINGS), version: int = 1
) -> DataFrame:
    """The five known vendors as a registry table; those not in ``active`` are registered only."""
    rows = []
    for oem, fields in VENDOR_MAPPINGS.items():
        specs = {
            name: {**spec, "truthy": [as_text(v) for v in spec["truthy"]]} if "truthy" in spec else spec
            for name, spec in fields.items()
        }
        rows.append({"oem": oem, "version": version, "active": oem in active, "fields": list(specs.items())})
    # a small Arrow table becomes a local relation: collecting or joining it runs no Python and no job
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(MAPPING_SCHEMA)), MAPPING_SCHEMA)


def validate_mappings(m: DataFrame) -> DataFrame:
    """(oem, version, ok, issues): issues in field order as ``<field>:<what is wrong>``."""
    checks = [F.when(~F.coalesce(F.col("oem").rlike(OEM_PATTERN), F.lit(False)), F.lit("oem:invalid"))]
    for name in REQUIRED_FIELDS + OPTIONAL_FIELDS:
        spec = F.col("fields")[name]
        there = spec.isNotNull()

        def bad(condition: Column, what: str, there=there, name=name) -> Column:
            return F.when(there & condition, F.lit(f"{name}:{what}"))

        if name in REQUIRED_FIELDS:
            checks.append(F.when(~there, F.lit(f"{name}:missing")))
        length = F.coalesce(F.length(spec["path"]), F.lit(0))
        checks += [
            bad((length < 1) | (length > 100), "path"),
            bad(spec["unit"].isNotNull() & ~spec["unit"].isin(*UNITS), "unit"),
            bad(spec["scale"].isNotNull() & ~(spec["scale"] > 0), "scale"),
            bad(spec["format"].isNotNull() & ~spec["format"].isin(*TS_FORMATS), "format"),
            bad(F.coalesce(F.length(spec["split"]), F.lit(0)) > 3, "split"),
        ]
    issues = F.array_compact(F.array(*checks))
    return m.select("oem", "version", issues.alias("issues")).withColumn(
        "ok", F.size("issues") == 0
    )


def register_mapping(m: DataFrame, candidate: DataFrame, order: str = "arrival") -> DataFrame:
    """The registry with the candidates added, inactive, numbered on from each vendor's maximum."""
    top = m.groupBy("oem").agg(F.max("version").alias("_top"))
    fresh = (
        numbered(candidate, ["oem"], order, name="_n")
        .join(top, "oem", "left")
        .select(
            "oem",
            (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int").alias("version"),
            F.lit(False).alias("active"),
            "fields",
        )
    )
    return m.select("oem", "version", "active", "fields").unionByName(fresh)


def activate_mapping(
    m: DataFrame, oem: str, version: int, as_of: dt.datetime | None = None
) -> DataFrame:
    """Make one version of a vendor the only active one; an unknown version changes nothing."""
    target = (F.col("oem") == oem) & (F.col("version") == version)
    found = m.filter(target).agg((F.count("*") > 0).alias("found")).scalar()
    switch = (F.col("oem") == oem) & found
    out = m.withColumn(
        "active", F.when(switch, F.col("version") == version).otherwise(F.col("active"))
    )
    if as_of is not None:
        out = out.withColumn("activated_at", F.when(target, F.lit(as_of)))
    return out


def active_mappings(m: DataFrame) -> DataFrame:
    """One active document per vendor; the newest wins should several be active."""
    rest = [c for c in m.columns if c != "oem"]
    return (
        m.filter("active")
        .groupBy("oem")
        .agg(F.max_by(F.struct(*rest), F.col("version")).alias("_doc"))
        .select("oem", "_doc.*")
    )


def list_mappings(m: DataFrame) -> DataFrame:
    return m.orderBy(F.asc("oem"), F.desc("version"))


def mapping_dict(mappings: DataFrame | dict) -> dict[str, dict]:
    """``{oem: {"version": int, "fields": {...}}}`` of the active documents."""
    if isinstance(mappings, dict):
        return mappings
    out = {}
    for row in active_mappings(mappings).collect():
        fields = {k: v.asDict() for k, v in (row["fields"] or {}).items()}
        out[row["oem"]] = {"version": row["version"] or 1, "fields": fields}
    return out


def by_vendor(
    registry: dict[str, dict], field: str, build: Callable[[dict, dict], str | None]
) -> Column:
    """One CASE over the vendors that specify ``field``; null for the others.

    ``build`` gives SQL text, so a registry of any size costs one expression to parse.
    """
    arms = []
    for oem in sorted(registry):
        spec = registry[oem]["fields"].get(field)
        value = build(spec, registry[oem]) if spec is not None else None
        if value is not None:
            arms.append(f"WHEN {quoted(oem)} THEN {value}")
    return F.expr(f"CASE oem {' '.join(arms)} END") if arms else F.lit(None)
