"""Vendor payloads to canonical events, by data-driven mappings compiled to expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoy.functions.fields import (
    as_text,
    fault_codes,
    finite,
    number_problem,
    parse_ts,
    path_sql,
    quoted,
    to_number,
    unit_factor,
)
from convoy.functions.plan import settle
from convoy.functions.vin import is_valid_vin, packed_check_digit, vin_problem
from convoy.operators.mapping import by_vendor, mapping_dict
from convoy.schemas import (
    CANONICAL_COLUMNS,
    CANONICAL_SCHEMA,
    DTC_PATTERN,
    OPTIONAL_FIELDS,
    REQUIRED_FIELDS,
)

# numeric fields and the quantity whose units apply to them
_NUMBERS = {
    "lat": None,
    "lon": None,
    "speed_kmh": "speed",
    "odo_km": "distance",
    "seq": None,
    "fuel_pct": None,
    "rpm": None,
}
MAX_SAFE_INTEGER = float(2**53 - 1)


def _missing(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit(f"invalid:{column}:missing"))


def _outside(column: str, low: float, high: float | None = None) -> Column:
    value = F.col(column)
    bad = value < low if high is None else (value < low) | (value > high)
    return F.when(bad, F.lit(f"invalid:{column}:out_of_range"))


def invalid_reason(check: Column | None = None) -> Column:
    """First constraint a canonical row breaks, in field order; null for a valid row.

    Only fuel, rpm and event may be missing. ``check`` is the VIN's check digit if there is a column of it.
    """
    bad_code = F.array_position(
        F.transform("dtc", lambda x: ~F.coalesce(x.rlike(DTC_PATTERN), F.lit(False))), True
    )
    seq = F.col("seq").cast("double")
    return F.coalesce(
        _missing("vin"),
        F.when(~is_valid_vin(F.col("vin"), check), F.lit("invalid:vin:invalid_vin")),
        _missing("oem"),
        F.when(~F.length("oem").between(1, 20), F.lit("invalid:oem:length")),
        F.when(F.col("ts").isNull(), F.lit("invalid:ts:invalid_ts")),
        _missing("lat"),
        _outside("lat", -90, 90),
        _missing("lon"),
        _outside("lon", -180, 180),
        _missing("speed_kmh"),
        _outside("speed_kmh", 0, 400),
        _missing("odo_km"),
        _outside("odo_km", 0),
        _outside("fuel_pct", 0, 100),
        _missing("engine_on"),
        _outside("rpm", 0, 12000),
        _missing("dtc"),
        F.when(
            bad_code > 0,
            F.concat(F.lit("invalid:dtc."), (bad_code - 1).cast("string"), F.lit(":invalid_dtc")),
        ),
        F.when(F.length("evt") > 32, F.lit("invalid:evt:too_long")),
        _missing("seq"),
        F.when(seq != F.floor(seq), F.lit("invalid:seq:not_integer")),
        F.when((seq < 0) | (seq > MAX_SAFE_INTEGER), F.lit("invalid:seq:out_of_range")),
        _missing("schema_ver"),
        F.when(F.col("schema_ver") < 1, F.lit("invalid:schema_ver:out_of_range")),
    )


def validate(canonical: DataFrame) -> DataFrame:
    """Add ``reason``: the first failing field of each canonical row, or null."""
    return canonical.withColumn("reason", invalid_reason())


def _constants(registry: dict[str, dict]) -> Column:
    """The vendors' constants (version, time format, separator, factors, scales) as one struct."""

    def constants(doc: dict) -> str:
        spec = {name: doc["fields"].get(name) or {} for name in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)}
        parts = {
            "version": f"{int(doc.get('version') or 1)}",
            "format": quoted(spec["ts"].get("format") or "iso"),
            "split": quoted(spec["dtc"].get("split") or ","),
            "engine": f"{'engine_on' in doc['fields']}".lower(),
            "truthy": "array(" + ", ".join(quoted(as_text(v)) for v in spec["engine_on"].get("truthy") or (True,)) + ")",
        }
        for name in _NUMBERS:
            factor = unit_factor(_NUMBERS[name], spec[name].get("unit")) if _NUMBERS[name] else 1.0
            parts[f"factor_{name}"] = f"{factor!r}D"
            parts[f"scale_{name}"] = f"{float(spec[name].get('scale') or 1.0)!r}D"
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"

    arms = " ".join(f"WHEN {quoted(o)} THEN {constants(registry[o])}" for o in sorted(registry))
    return F.expr(f"CASE oem {arms} END")


def _read_number(field: str) -> list[Column]:
    """Kind, value and text of a numeric field: a JSON number gives its value (and a text that is none), all else its text."""
    kind, value = F.schema_of_variant(f"v_{field}"), F.col(f"v_{field}")
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return [
        kind.alias(f"k_{field}"),
        F.when(is_number, F.try_variant_get(value, "$", "double")).alias(f"d_{field}"),
        F.when(is_number, F.lit("number")).otherwise(F.try_variant_get(value, "$", "string")).alias(f"t_{field}"),
    ]


def normalise(raw: DataFrame, mappings) -> DataFrame:
    """Canonical columns plus ``reason`` for every row of ``raw`` (columns ``oem, payload, ...``).

    The other columns of ``raw`` pass through. An earlier non-null ``reason`` is kept. Every vendor
    is served by the same scan: a field is picked by one CASE over the vendors, and from there on all
    vendors share one small set of conversions, done in steps so that nothing is spelt out twice.
    Failures are named in reading order: vin, ts, time format, lat, lon, speed, odometer,
    sequence, then the constraints of :func:`validate`.
    """
    registry = mapping_dict(mappings)
    carried = [c for c in raw.columns if c not in (*CANONICAL_COLUMNS, "payload", "reason")]
    fields = (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)
    prior = F.col("reason") if "reason" in raw.columns else F.lit(None).cast("string")
    if not registry:
        empty = [F.lit(None).cast(CANONICAL_SCHEMA[c].dataType).alias(c) for c in CANONICAL_COLUMNS if c != "oem"]
        out = raw.select(*carried, "payload", "oem", *empty, F.coalesce(prior, F.lit("no_mapping")).alias("reason"))
        return out.select(*carried, "payload", *CANONICAL_COLUMNS, "reason")

    picked = raw.select(
        *carried,
        "oem",
        "payload",
        prior.alias("_prior"),
        _constants(registry).alias("_c"),
        *[
            by_vendor(registry, f, lambda s, _: path_sql(s["path"], "variant")).cast("variant").alias(f"v_{f}")
            for f in fields
        ],
    )
    kept = [*carried, "oem", "payload", "_prior", "_c"]
    texts = picked.select(
        *kept, "v_dtc", "v_ts",
        *[F.try_variant_get(f"v_{f}", "$", "string").alias(f"t_{f}") for f in fields if f not in _NUMBERS],
        *[c for f in _NUMBERS for c in _read_number(f)],
    )
    ts_kind = F.schema_of_variant("v_ts")
    numbers = texts.select(
        *kept, *[f"t_{f}" for f in fields],
        *[F.coalesce(finite(F.col(f"d_{f}")), to_number(F.col(f"t_{f}"), F.col(f"k_{f}"))).alias(f"n_{f}") for f in _NUMBERS],
        parse_ts(F.col("t_ts"), F.col("_c.format"), ts_kind).alias("ts"),
        F.try_variant_get("v_dtc", "$", "array<string>").alias("_items"),
        F.schema_of_variant("v_dtc").alias("_dtc_kind"),
    )

    values = {
        f: F.col(f"n_{f}") * F.col(f"_c.factor_{f}") * F.col(f"_c.scale_{f}") for f in _NUMBERS
    }
    values["speed_kmh"] = F.greatest(F.lit(0.0), values["speed_kmh"])
    for optional in ("fuel_pct", "rpm"):
        values[optional] = F.when(F.col(f"t_{optional}") != "", values[optional])
    typed = numbers.select(
        *carried, "oem", "payload", "_prior", "ts",
        *[f"t_{f}" for f in REQUIRED_FIELDS],
        *[f"n_{f}" for f in _NUMBERS],
        F.upper("t_vin").alias("vin"),
        packed_check_digit(F.upper("t_vin")).alias("_check"),
        *[value.alias(f) for f, value in values.items()],
        fault_codes(F.col("_items"), F.col("t_dtc"), F.col("_dtc_kind"), F.col("_c.split")).alias("dtc"),
        F.coalesce(
            F.col("_c.engine") & F.array_contains("_c.truthy", F.col("t_engine_on")), F.lit(False)
        ).alias("engine_on"),
        F.upper(F.when(F.col("t_evt") != "", F.col("t_evt"))).alias("evt"),
        F.col("_c.version").alias("schema_ver"),
    )

    def unspecified(field: str) -> list[Column]:
        lacking = [o for o, doc in registry.items() if doc["fields"].get(field) is None]
        return [F.when(F.col("oem").isin(*lacking), F.lit("mapping_exception"))] if lacking else []

    reading = F.coalesce(
        F.col("_prior"),
        F.when(F.col("schema_ver").isNull(), F.lit("no_mapping")),
        *unspecified("vin"),
        F.when(F.col("t_vin").isNull(), F.lit("missing:vin")),
        *unspecified("ts"),
        F.when(F.col("t_ts").isNull(), F.lit("missing:ts")),
        F.when(F.col("ts").isNull(), F.lit("bad_ts")),
        *[
            c
            for f in REQUIRED_FIELDS[2:]
            for c in (*unspecified(f), number_problem(F.col(f"t_{f}"), F.col(f"n_{f}"), f))
        ],
    )
    judged = typed.withColumn("reason", reading).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("reason").isNull(), invalid_reason(F.col("_check"))))
    )
    usable = F.col("reason").isNull()
    shown = [
        (F.when(usable, F.col("seq").cast("bigint")) if c == "seq" else F.col(c)).alias(c)
        for c in CANONICAL_COLUMNS
    ]
    return settle(judged.select(*carried, "payload", *shown, "reason"), "reason")


def first_failure(canonical: DataFrame) -> DataFrame:
    """Rows per failure reason, accepted rows under a null reason."""
    return canonical.groupBy("reason").agg(F.count("*").alias("n"))


def preview_mapping(raw: DataFrame, candidate: dict[str, dict]) -> DataFrame:
    """Dry run of candidate field specs (version 1): every payload's event or reason."""
    registry = {oem: {"version": 1, "fields": fields} for oem, fields in candidate.items()}
    return normalise(raw, registry)


def audit_vins(df: DataFrame, vin_col: str = "vin", by: str = "oem") -> DataFrame:
    """Rows per vendor and VIN problem; ``ok`` for valid ones."""
    return (
        df.groupBy(by, F.coalesce(vin_problem(F.col(vin_col)), F.lit("ok")).alias("problem"))
        .agg(F.count("*").alias("n"))
    )
