"""Fixed values and table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# VIN alphabet, letter values, position weights (ISO 3779, North American check digit).
VIN_PATTERN = "^[A-HJ-NPR-Z0-9]{17}$"
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_LETTER_DIGITS = "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)

# OBD-II trouble code shape and vendor code shape.
DTC_PATTERN = "^[PBCU][0-3][0-9A-F]{3}$"
OEM_PATTERN = "^[A-Z0-9_-]{1,20}$"

# Unit factors to km/h and km.
SPEED_FACTORS = {"kmh": 1.0, "kph": 1.0, "mph": 1.609344, "ms": 3.6}
DISTANCE_FACTORS = {"km": 1.0, "mi": 1.609344}
UNITS = ("kmh", "kph", "mph", "ms", "km", "mi")
TS_FORMATS = ("epoch_ms", "epoch_s", "iso", "ddmmyyyy_hms")
REQUIRED_FIELDS = ("vin", "ts", "lat", "lon", "speed_kmh", "odo_km", "seq")
OPTIONAL_FIELDS = ("fuel_pct", "engine_on", "rpm", "dtc", "evt")
FALLBACK_VIN_KEYS = ("vin", "VIN", "vehicleId", "v", "chassis")

# Alert rules and their severities, in evaluation order.
RULE_SEVERITY = {
    "IDLING_EXCESSIVE": "warning",
    "HARSH_BRAKE_BURST": "warning",
    "DTC_REPEAT": "critical",
    "OVERSPEED_ANOMALY": "warning",
    "LOW_FUEL": "info",
}

# Model inputs, latency buckets in seconds, geohash alphabet, mean Earth radius in km.
RISK_FEATURES = (
    "idle_ratio",
    "harsh_ratio",
    "dtc_ratio",
    "overspeed_ratio",
    "lowfuel_ratio",
    "km_per_hour",
    "odo_km",
)
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_RADIUS_KM = 6371.0088

FIELD_SPEC = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("format", T.StringType()),
        T.StructField("truthy", T.ArrayType(T.StringType())),
        T.StructField("split", T.StringType()),
    ]
)

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("oem", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("fields", T.MapType(T.StringType(), FIELD_SPEC)),
    ]
)

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("vin", T.StringType()),
        T.StructField("oem", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("speed_kmh", T.DoubleType()),
        T.StructField("odo_km", T.DoubleType()),
        T.StructField("fuel_pct", T.DoubleType()),
        T.StructField("engine_on", T.BooleanType()),
        T.StructField("rpm", T.DoubleType()),
        T.StructField("dtc", T.ArrayType(T.StringType())),
        T.StructField("evt", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("schema_ver", T.IntegerType()),
    ]
)
CANONICAL_COLUMNS = tuple(f.name for f in CANONICAL_SCHEMA.fields)

# The five vendor mappings (config data, version 1).
VENDOR_MAPPINGS = {
    "A": {
        "vin": {"path": "vehicleId"},
        "ts": {"path": "timestamp", "format": "epoch_ms"},
        "lat": {"path": "position.latitude"},
        "lon": {"path": "position.longitude"},
        "speed_kmh": {"path": "velocityMph", "unit": "mph"},
        "odo_km": {"path": "odometerMiles", "unit": "mi"},
        "fuel_pct": {"path": "fuelLevel", "scale": 100.0},
        "engine_on": {"path": "ignition", "truthy": ["ON"]},
        "rpm": {"path": "engineRpm"},
        "dtc": {"path": "faultCodes"},
        "evt": {"path": "event"},
        "seq": {"path": "sequence"},
    },
    "B": {
        "vin": {"path": "vin"},
        "ts": {"path": "ts", "format": "iso"},
        "lat": {"path": "gps.0"},
        "lon": {"path": "gps.1"},
        "speed_kmh": {"path": "speed_kmh", "unit": "kmh"},
        "odo_km": {"path": "odo_km", "unit": "km"},
        "fuel_pct": {"path": "fuel_pct"},
        "engine_on": {"path": "engine_on", "truthy": [True]},
        "rpm": {"path": "rpm"},
        "dtc": {"path": "dtc"},
        "evt": {"path": "evt"},
        "seq": {"path": "seq"},
    },
    "C": {
        "vin": {"path": "VIN"},
        "ts": {"path": "time", "format": "ddmmyyyy_hms"},
        "lat": {"path": "lat"},
        "lon": {"path": "lng"},
        "speed_kmh": {"path": "speedMs", "unit": "ms"},
        "odo_km": {"path": "odoKm", "unit": "km"},
        "fuel_pct": {"path": "fuelPercent"},
        "engine_on": {"path": "engine", "truthy": [1]},
        "rpm": {"path": "rpm"},
        "dtc": {"path": "codes", "split": ";"},
        "evt": {"path": "evt"},
        "seq": {"path": "n"},
    },
    "D": {
        "vin": {"path": "v"},
        "ts": {"path": "t", "format": "epoch_s"},
        "lat": {"path": "la"},
        "lon": {"path": "lo"},
        "speed_kmh": {"path": "spd_mph", "unit": "mph"},
        "odo_km": {"path": "odo_mi", "unit": "mi"},
        "fuel_pct": {"path": "fl"},
        "engine_on": {"path": "eng", "truthy": [True]},
        "rpm": {"path": "r"},
        "dtc": {"path": "d"},
        "evt": {"path": "e"},
        "seq": {"path": "s"},
    },
    "E": {
        "vin": {"path": "chassis"},
        "ts": {"path": "unixTime", "format": "epoch_ms"},
        "lat": {"path": "coords.y"},
        "lon": {"path": "coords.x"},
        "speed_kmh": {"path": "kph", "unit": "kph"},
        "odo_km": {"path": "odometer", "unit": "km"},
        "fuel_pct": {"path": "fuel", "scale": 100.0},
        "engine_on": {"path": "running", "truthy": ["Y"]},
        "rpm": {"path": "revs"},
        "dtc": {"path": "dtcList"},
        "evt": {"path": "event"},
        "seq": {"path": "counter"},
    },
}
