"""Column functions on literal values."""

import json

import pytest
from pyspark.sql import functions as F

from convoy.functions import fields as fx, geo, vin
from convoy.functions.vin import is_valid_vin, vin_problem
from convoy.operators.mapping import active_mappings, vendor_registry
from convoy.operators.normalise import normalise, preview_mapping, validate
from convoy.operators.routing import route
from convoy.schemas import VENDOR_MAPPINGS
from convoy.sources.ndjson import classify_lines, decode_envelope, parse_ndjson, shown, with_partition_key

VIN = "1HGCM82633A004352"
GOOD = {
    "vehicleId": VIN, "timestamp": 1758795302000, "position": {"latitude": 13.08, "longitude": 80.27},
    "velocityMph": 50, "odometerMiles": 1000, "fuelLevel": 0.5, "ignition": "ON", "engineRpm": 1800,
    "faultCodes": ["p0301"], "event": "harsh_brake", "sequence": 7,
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def payload_rows(spark, docs, oem="A"):
    rows = [(i, oem, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return classify_lines(spark.createDataFrame(rows, "id int, oem string, line string"))


def reasons(spark, docs, oem="A", registry=None):
    out = normalise(payload_rows(spark, docs, oem), registry or vendor_registry(spark))
    return [r["reason"] for r in out.orderBy("id").collect()]


def test_vin_check_digit(spark):
    rows = spark.createDataFrame(
        [(VIN,), ("1HGCM82613A004352",), ("1HGCM82633A00435",), ("IHGCM82633A004352",), (VIN.lower(),), (None,)], "v string"
    )
    got = [r[0] for r in rows.select(vin_problem(F.col("v"))).collect()]
    assert got == [None, "check_digit", "length", "charset", None, "length"]
    assert one(spark, is_valid_vin(F.lit(VIN)))[0]


def test_packed_check_digit_is_the_check_digit(spark):
    """Vehicles of every check digit, odd texts of seventeen characters, and texts of other lengths, which must not fail."""
    made = [f"CVY{i * 7919 % 100000:05d}0{i:08d}" for i in range(60)] + [VIN, VIN.lower().upper(), "ZZZZZZZZ9ZZZZZZZZ", "99999999999999999"]
    rows = spark.createDataFrame([(v,) for v in made], "v string").select(vin.check_digit("v").alias("a"), vin.packed_check_digit(F.col("v")).alias("b"))
    got = rows.collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) == 11
    odd = spark.createDataFrame([(None,), ("",), ("-1234567-99999999",), ("\u00e9" * 17,), ("I" * 40,)], "v string")
    assert [r[0] for r in odd.select(vin_problem(F.col("v"), vin.packed_check_digit(F.col("v")))).collect()] == ["length", "length", "charset", "charset", "length"]


def test_numbers_keep_their_reading_by_kind(spark):
    """JSON numbers of every kind, number texts, switches, lists and what is beyond a double."""
    speeds = [50, 50.25, 5e1, 1e-3, "50", " 7.5 ", "", "1e400", None, True, False, [1], {"a": 1}, "0x10", "NaN", 12345678901234567890123456789012345678901234567890]
    docs = [json.dumps({**GOOD, "velocityMph": s}) for s in speeds] + [json.dumps(GOOD).replace('"velocityMph": 50', '"velocityMph": 1e400')]
    mapping = {"A": {"version": 1, "fields": {**VENDOR_MAPPINGS["A"], "speed_kmh": {"path": "velocityMph", "unit": "kmh"}}}}
    out = normalise(payload_rows(spark, docs), mapping).orderBy("id").collect()
    bad, gap, far = "bad_number:speed_kmh", "missing:speed_kmh", "invalid:speed_kmh:out_of_range"
    assert [r.reason for r in out] == [None] * 6 + [gap, bad, gap, None, None, bad, bad, bad, bad, far, bad]
    assert [r.speed_kmh for r in out[:6]] == [50, 50.25, 50, 0.001, 50, 7.5] and [out[9].speed_kmh, out[10].speed_kmh] == [1, 0]


def test_rejects_are_spread_by_raw_columns_only(spark):
    """The key of a rejected row asks for no canonical column, so the ones nobody reads are not computed."""
    raw = payload_rows(spark, [GOOD, {}]).drop("line")
    vehicles = spark.createDataFrame([(VIN, 1, 1)], "vin string, vehicle_id int, fleet_id int")
    out = route(raw, vendor_registry(spark), vehicles, spark.createDataFrame([(1, 1)], "fleet_id int, tenant_id int"))
    plan = out.select("id", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(" in plan and "schema_ver" not in plan[plan.index("xxhash64(") : plan.index("\n", plan.index("xxhash64("))]
    assert [r.reason for r in out.orderBy("id").collect()] == [None, "missing:vin"]


@pytest.mark.parametrize(
    "text, fmt, expected",
    [
        ("1758795302000", "epoch_ms", 1758795302000),
        ("1758795302", "epoch_s", 1758795302000),
        ("25/09/2025 10:15:02", "ddmmyyyy_hms", 1758795302000),
        ("2025-09-25T10:15:02.123456Z", "iso", 1758795302123),
        ("2025-09-25T12:15:02+02:00", "iso", 1758795302000),
        ("2025-09-25", "iso", 1758758400000),
        ("31/02/2025 00:00:00", "ddmmyyyy_hms", 1740960000000),  # rolls over to 3 March
        ("garbage", "iso", None),
        ("garbage", "epoch_ms", None),
        ("5/9/2025 10:15:02", "ddmmyyyy_hms", None),
    ],
)
def test_parse_ts(spark, text, fmt, expected):
    assert one(spark, F.unix_millis(fx.parse_ts(F.lit(text), fmt)))[0] == expected


def test_numbers(spark):
    texts = ["36.5", " 7 ", "", "1e3", "0x10", "NaN", "Infinity", "1d", "-.5", "1e999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(fx.to_number(F.col("t"))).collect()]
    assert got == [36.5, 7.0, 0.0, 1000.0, None, None, None, None, -0.5, None]
    value, reason = fx.required_number(F.col("t"), "x", 2.0)
    got = [tuple(r) for r in rows.select(value, reason).collect()][:3]
    assert got == [(73.0, None), (14.0, None), (0.0, "missing:x")]


def test_unit_of_another_quantity_is_ignored():
    assert fx.unit_factor("speed", "mi") == 1.0
    assert fx.unit_factor("distance", "mi") == 1.609344


def test_failure_reasons(spark):
    def without(key, **changes):
        return {**{k: v for k, v in GOOD.items() if k != key}, **changes}

    docs = [
        GOOD, without("vehicleId"), without("timestamp"), {**GOOD, "velocityMph": "fast"}, without("odometerMiles"),
        {**GOOD, "timestamp": "x"}, {**GOOD, "vehicleId": "1HGCM82613A004352"}, {**GOOD, "faultCodes": ["P0301", "nope"]},
        {**GOOD, "position": {"latitude": 91, "longitude": 0}}, {**GOOD, "sequence": 1.5}, {**GOOD, "velocityMph": -3},
        {**GOOD, "velocityMph": True}, {**GOOD, "odometerMiles": ""}, "nope", "[1,2]",
    ]
    assert reasons(spark, docs) == [
        None, "missing:vin", "missing:ts", "bad_number:speed_kmh", "missing:odo_km", "bad_ts", "invalid:vin:invalid_vin",
        "invalid:dtc.1:invalid_dtc", "invalid:lat:out_of_range", "invalid:seq:not_integer", None, None, "missing:odo_km",
        "bad_json", "not_object",
    ]
    assert reasons(spark, [GOOD], oem="Z") == ["no_mapping"]
    broken = {"A": {"version": 1, "fields": {k: v for k, v in VENDOR_MAPPINGS["A"].items() if k != "lat"}}}
    assert reasons(spark, [GOOD], registry=broken) == ["mapping_exception"]


def test_canonical_event(spark):
    row = normalise(payload_rows(spark, [GOOD]), vendor_registry(spark)).first()
    assert (row["vin"], row["oem"], row["dtc"], row["evt"], row["seq"]) == (VIN, "A", ["P0301"], "HARSH_BRAKE", 7)
    assert row["speed_kmh"] == pytest.approx(80.4672) and row["odo_km"] == pytest.approx(1609.344)
    assert row["fuel_pct"] == 50.0 and row["engine_on"] and row["schema_ver"] == 1


def test_fault_codes_and_switch_of_text_vendor(spark):
    doc = {
        "VIN": VIN, "time": "25/09/2025 10:15:02", "lat": 1, "lng": 2, "speedMs": 10, "odoKm": 5, "fuelPercent": "40.5",
        "engine": 1, "codes": " p0301 ;;U0100", "evt": "", "n": 1,
    }
    row = normalise(payload_rows(spark, [doc], "C"), vendor_registry(spark)).first()
    assert (row["dtc"], row["evt"], row["engine_on"], row["fuel_pct"]) == (["P0301", "U0100"], None, True, 40.5)
    assert row["speed_kmh"] == 36.0 and row["reason"] is None


def test_numeric_path_step_reads_arrays_and_keys(spark):
    p = F.parse_json(F.lit('{"gps":[1.5,2],"m":{"0":"k"}}'))
    row = spark.range(1).select(p.alias("payload")).select(
        fx.extract_path("payload", "gps.1"), fx.extract_path("payload", "m.0"), fx.extract_path("payload", "x.y")
    ).first()
    assert tuple(row) == ("2", "k", None)


def test_preview_uses_version_one(spark):
    row = preview_mapping(payload_rows(spark, [GOOD]), {"A": VENDOR_MAPPINGS["A"]}).first()
    assert row["reason"] is None and row["schema_ver"] == 1


def test_validate_order(spark):
    row = normalise(payload_rows(spark, [GOOD]), vendor_registry(spark)).drop("reason")
    bad = row.withColumn("lon", F.lit(500.0)).withColumn("rpm", F.lit(-1.0))
    assert validate(bad).first()["reason"] == "invalid:lon:out_of_range"


def test_several_active_versions_newest_wins(spark):
    both = vendor_registry(spark).unionByName(vendor_registry(spark, version=2))
    assert {r["version"] for r in active_mappings(both).collect()} == {2}


def test_ndjson(spark):
    text = '{"a":1}\nnot json\n[1,2]\n\n{"b":2}\n{"c":3} x\nnull\n7\n{"d":1},{"e":2}\n'
    df = spark.createDataFrame([(1, text)], "batch_id int, text string")
    out = classify_lines(parse_ndjson(df)).orderBy("line_no").collect()
    assert [r["reason"] for r in out] == [
        None, "bad_json", "not_object", None, "bad_json", "not_object", "not_object", "bad_json"
    ]
    ten = spark.createDataFrame([(1, "\n".join(['{"a":1}'] * 10))], "batch_id int, text string")
    cut = parse_ndjson(ten, max_lines=5).orderBy("line_no").collect()
    assert [r["truncated"] for r in cut] == [False] * 5 + [True] * 5
    assert not any(r["truncated"] for r in parse_ndjson(ten).collect())


def test_lines_stay_whole(spark):
    long = json.dumps({"a": "x" * 900})
    df = spark.createDataFrame([(1, long), (2, "y" * 900)], "id int, line string")
    got = {r["id"]: (len(r["line"]), len(r["s"])) for r in classify_lines(df).withColumn("s", shown()).collect()}
    assert got == {1: (len(long), 300), 2: (900, 300)}


def test_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',)], "line string")
    row = classify_lines(df).select("reason", F.try_variant_get("payload", "$.a", "int").alias("a")).first()
    assert tuple(row) == (None, 2)


def test_missing_values_are_invalid(spark):
    good = normalise(payload_rows(spark, [GOOD]), vendor_registry(spark)).drop("reason")
    kinds = dict(good.dtypes)
    for field in ("vin", "oem", "lat", "lon", "speed_kmh", "odo_km", "engine_on", "dtc", "seq", "schema_ver"):
        bad = good.withColumn(field, F.lit(None).cast(kinds[field]))
        assert validate(bad).first()["reason"] == f"invalid:{field}:missing"
    for field in ("fuel_pct", "rpm", "evt"):
        assert validate(good.withColumn(field, F.lit(None).cast(kinds[field]))).first()["reason"] is None


def test_envelope_and_key(spark):
    values = ['{"oem":"A","r":5,"p":{"vehicleId":"V1"}}', "{oops", '{"oem":"Q","r":5,"p":{"vin":7,"chassis":"C9"}}', "null"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")
    out = decode_envelope(df)
    keyed = with_partition_key(out, vendor_registry(spark)).orderBy("id").collect()
    assert [r["reason"] for r in keyed] == [None, "bad_envelope", None, "bad_envelope"]
    assert [r["key"] for r in keyed] == ["V1", None, "C9", None]


def test_geohash_and_distance(spark):
    row = one(
        spark,
        geo.geohash(F.lit(57.64911), F.lit(10.40744), 11),
        geo.haversine_km(F.lit(13.0827), F.lit(80.2707), F.lit(12.9716), F.lit(77.5946)),
        geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)),
        geo.geohash(F.lit(90.0), F.lit(180.0), 3),
    )
    assert row[0] == "u4pruydqqvj" and 280 < row[1] < 300 and row[2] == 0 and row[3] == "zzz"


def test_geohash_round_trip_and_bad_cell(spark):
    cells = spark.createDataFrame([("u4pruyd",), ("u4pruya",), ("u4p",)], "c string")
    lat, lon, lat_err, lon_err = geo.geohash_bounds(F.col("c"), 7)
    rows = cells.select(lat.alias("lat"), lon.alias("lon"), lat_err.alias("e"), geo.geohash(lat, lon, 7).alias("g")).collect()
    assert rows[0]["g"] == "u4pruyd" and abs(rows[0]["lat"] - 57.64911) <= rows[0]["e"] * 1.01
    assert rows[1]["lat"] is None and rows[2]["lat"] is None
