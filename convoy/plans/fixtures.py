"""Telemetry-shaped views over the given tables, as one SQL text for Spark and for the SQL check.

Each view is a chain of common table expressions. The few spellings that differ between the two
engines are the fields of :class:`Dialect`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from convoy.functions.fields import unit_factor
from convoy.schemas import VENDOR_MAPPINGS, VIN_LETTER_DIGITS, VIN_LETTERS, VIN_WEIGHTS
from convoy.session import configure, shared_dir

BASE_MS = 1704067200000  # 2024-01-01T00:00:00Z, the start of the events table
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Dialect:
    epoch_ms: Callable[[str], str]
    ts: Callable[[str], str]
    iso: Callable[[str], str]
    dmy: Callable[[str], str]
    strings: Callable[[str], str]
    no_strings: str
    lines: str


SPARK = Dialect(
    epoch_ms=lambda c: f"CAST(FLOOR(unix_micros(CAST({c} AS TIMESTAMP))/1000.0) AS BIGINT)",
    ts=lambda ms: f"timestamp_millis({ms})",
    iso=lambda ms: f"date_format(timestamp_millis({ms}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
    dmy=lambda ms: f"date_format(timestamp_millis({ms}), 'dd/MM/yyyy HH:mm:ss')",
    strings=lambda s: f"array({s})",
    no_strings="CAST(array() AS ARRAY<STRING>)",
    lines="array_join(transform(array_sort(collect_list(struct(arrival, line))), x -> x.line), '\\n')",
)
DUCK = Dialect(
    epoch_ms=lambda c: f"CAST(FLOOR(epoch_us({c})/1000.0) AS BIGINT)",
    ts=lambda ms: f"make_timestamp(({ms})*1000)",
    iso=lambda ms: f"strftime(make_timestamp(({ms})*1000), '%Y-%m-%dT%H:%M:%S.%gZ')",
    dmy=lambda ms: f"strftime(make_timestamp(({ms})*1000), '%d/%m/%Y %H:%M:%S')",
    strings=lambda s: f"[{s}]",
    no_strings="CAST([] AS VARCHAR[])",
    lines="string_agg(line, chr(10) ORDER BY arrival)",
)


def _fixed(x: str, places: int) -> str:
    """Text of x with a fixed number of decimals, half up, the same in both engines."""
    unit = "0." + "0" * (places - 1) + "1"
    return f"CAST(CAST(FLOOR(({x})*1e{places}+0.5e0) AS DECIMAL(18,0))*{unit} AS STRING)"


def _vin_body(n: str) -> str:
    """Seventeen characters that tell n apart; the ninth gives way to the check digit."""
    spread = f"lpad(CAST({n} * 7919 % 100000 AS STRING), 5, '0')"
    return f"'CVY' || {spread} || '0' || lpad(CAST({n} AS STRING), 8, '0')"


def _vin_chain(source: str, n: str) -> str:
    """Query adding ``vin`` to every row of ``source``, built from the integer expression ``n``."""
    total = " + ".join(
        f"{w}*CAST(substr(vin_coded, {i + 1}, 1) AS INT)" for i, w in enumerate(VIN_WEIGHTS) if w
    )
    return f"""
      SELECT *, substr(vin_body, 1, 8) || CASE WHEN vin_rest = 10 THEN 'X' ELSE CAST(vin_rest AS STRING) END
                || substr(vin_body, 10) AS vin
      FROM (SELECT *, ({total}) % 11 AS vin_rest
            FROM (SELECT *, translate(vin_body, '{VIN_LETTERS}', '{VIN_LETTER_DIGITS}') AS vin_coded
                  FROM (SELECT *, {_vin_body(n)} AS vin_body FROM {source}) a) b) c"""


def _event_rows(d: Dialect) -> str:
    return f"""SELECT event_id, user_id, event_type, value, {d.epoch_ms('ts')} AS ms,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"""


def _telemetry(d: Dialect) -> str:
    fast = f"{BASE_MS} + CAST(FLOOR((ms - {BASE_MS})/600e0) AS BIGINT)"
    return f"""
    SELECT event_id, user_id AS vehicle_id, 1 + user_id % 3 AS fleet_id, vin,
           substr('ABCDE', CAST(1 + user_id % 5 AS INT), 1) AS oem,
           ms AS ts_ms, {d.ts('ms')} AS ts, {fast} AS fast_ms, k,
           12e0 + user_id % 7 + k/1000e0 AS lat, 77e0 + user_id % 5 + k/500e0 AS lon,
           CASE WHEN event_type IN ('signup', 'error') THEN 0e0 ELSE least(value, 400e0) END AS speed_kmh,
           1000e0 + event_id/10e0 AS odo_km,
           CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS fuel_pct,
           event_type <> 'view' AS engine_on,
           CAST(FLOOR(least(value*10, 12000e0)) AS INT) AS rpm,
           CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'P0301' ELSE 'P0420' END ELSE '' END AS dtc_code,
           CASE WHEN event_type = 'error' THEN {d.strings("CASE WHEN k % 2 = 0 THEN 'P0301' ELSE 'P0420' END")}
                ELSE {d.no_strings} END AS dtc,
           CASE WHEN event_type = 'click' THEN 'HARSH_BRAKE' END AS evt,
           event_id AS seq
    FROM ({_vin_chain('event_rows', '(user_id + 1)')}) v"""


def _telemetry_fast(d: Dialect) -> str:
    return f"""SELECT event_id, vehicle_id, fleet_id, vin, oem, fast_ms AS ts_ms, {d.ts('fast_ms')} AS ts, lat, lon,
           speed_kmh, odo_km, fuel_pct, engine_on, rpm, dtc, dtc_code, evt, seq FROM telemetry"""


def _telemetry_sparse(d: Dialect) -> str:
    return f"""SELECT event_id, vehicle_id, fleet_id, vin, oem, ts_ms, ts, lat, lon, speed_kmh, odo_km,
           fuel_pct, engine_on, rpm, CASE WHEN k % 50 = 0 THEN dtc ELSE {d.no_strings} END AS dtc,
           CASE WHEN k % 50 = 0 THEN dtc_code ELSE '' END AS dtc_code,
           CASE WHEN k % 50 = 0 THEN evt END AS evt, seq FROM telemetry"""


def _arrivals(d: Dialect) -> str:
    late = "CASE WHEN event_id % 33 = 0 THEN 129600000 ELSE 0 END"
    return f"""
    SELECT *, {d.ts('received_ms')} AS received_at,
           (received_ms - {BASE_MS})*1000000000 + event_id*2 + copy AS arrival
    FROM (SELECT *, 0 AS copy, ts_ms + 200 + (event_id % 50)*100 + {late} AS received_ms FROM telemetry
          UNION ALL
          SELECT *, 1 AS copy, ts_ms + 205 + (event_id % 50)*100 + {late} AS received_ms FROM telemetry
          WHERE event_id % 20 = 0) a"""


#: Decimals of every measured number in the vendors' text.
WIRE_PLACES = 5
#: What a spoilt field holds instead of its value, by the row's defect.
SPOILT = {"lat": (59, "999"), "odo_km": (71, "null"), "speed_kmh": (73, '"fast"'), "ts": (79, '"garbage"')}


def _in_quotes(text: str) -> str:
    return f"'\"' || {text} || '\"'"


def _wire_value(d: Dialect, field: str, spec: dict, listless: bool) -> str:
    """SQL for the JSON text of one field as its mapping would read it back; null leaves the key out.

    ``listless`` vendors write lists as text, and with them the fuel level and an empty event.
    """
    if field == "vin":
        return _in_quotes("w_vin")
    if field == "ts":
        return {
            "epoch_ms": "CAST(ts_ms AS STRING)",
            "epoch_s": "CAST(CAST(FLOOR(ts_ms/1000.0) AS BIGINT) AS STRING)",
            "iso": _in_quotes(d.iso("ts_ms")),
            "ddmmyyyy_hms": _in_quotes(d.dmy("ts_ms")),
        }[spec["format"]]
    if field == "engine_on":
        yes = spec["truthy"][0]
        no = type(yes)() if not isinstance(yes, str) else f"-{yes}"
        return f"CASE WHEN engine_on THEN '{json.dumps(yes)}' ELSE '{json.dumps(no)}' END"
    if field == "dtc":
        return _in_quotes("w_codes") if listless else f"'[' || CASE WHEN w_codes = '' THEN '' ELSE {_in_quotes('w_codes')} END || ']'"
    if field == "evt":
        return _in_quotes("coalesce(evt, '')") if listless else f"coalesce({_in_quotes('evt')}, 'null')"
    if field in ("seq", "rpm"):
        return f"CAST({field} AS STRING)"
    quantity = {"speed_kmh": "speed", "odo_km": "distance"}.get(field)
    divisor = (unit_factor(quantity, spec.get("unit")) if quantity else 1.0) * spec.get("scale", 1.0)
    number = _fixed(f"{field}/{divisor}e0", WIRE_PLACES)
    return _in_quotes(number) if listless and field == "fuel_pct" else number


def _wire_node(node: dict | str) -> str:
    """SQL for the JSON text of a tree of path steps; steps that are numbers make a list."""
    if isinstance(node, str):
        return node
    if all(step.isdigit() for step in node):
        return "'[' || concat_ws(',', " + ", ".join(_wire_node(node[k]) for k in sorted(node, key=int)) + ") || ']'"
    members = (f"'\"{step}\":' || {_wire_node(below)}" for step, below in node.items())
    return "'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"


def _wire_document(d: Dialect, mapping: dict[str, dict]) -> str:
    """SQL for a vendor's document: every mapped field at its path."""
    tree: dict = {}
    for field, spec in mapping.items():
        value = _wire_value(d, field, spec, "split" in mapping["dtc"])
        if field in SPOILT:
            value = "CASE WHEN defect = {} THEN '{}' ELSE {} END".format(*SPOILT[field], value)
        *above, last = spec["path"].split(".")
        node = tree
        for step in above:
            node = node.setdefault(step, {})
        node[last] = value
    return _wire_node(tree)


def _wire(d: Dialect, source: str) -> str:
    """Vendor JSON of every row; ``defect`` names the part that is spoilt (null for none)."""
    body = " ".join(f"WHEN '{oem}' THEN {_wire_document(d, mapping)}" for oem, mapping in VENDOR_MAPPINGS.items())
    return f"""
    SELECT event_id, copy, arrival, received_ms, received_at, vehicle_id, vin AS true_vin,
           CASE WHEN defect = 53 THEN 'Z' ELSE oem END AS oem,
           CASE WHEN defect = 97 THEN 'not json' WHEN defect = 89 THEN '[1,2]' ELSE CASE oem {body} END END AS line
    FROM (SELECT *, CASE WHEN defect = 83 THEN NULL
                         WHEN defect = 67 THEN substr(vin, 1, 8) || CASE WHEN substr(vin, 9, 1) = '0' THEN '1' ELSE '0' END || substr(vin, 10)
                         ELSE vin END AS w_vin,
                 CASE WHEN defect = 61 THEN 'nope' ELSE dtc_code END AS w_codes
          FROM ({source}) s) w"""


def _defects() -> str:
    ladder = " ".join(
        f"WHEN event_id % {p} = 0 THEN {p}" for p in (97, 89, 83, 79, 73, 71, 67, 61, 59, 53)
    )
    return f"SELECT *, CASE {ladder} END AS defect FROM arrivals"


def _batches(d: Dialect) -> str:
    return f"""SELECT CAST(FLOOR(event_id/50.0) AS BIGINT) AS batch_id, ' ' || {_newline(d)} || {d.lines} AS text
               FROM wire_defects GROUP BY CAST(FLOOR(event_id/50.0) AS BIGINT)"""


def _newline(d: Dialect) -> str:
    return "'\\n'" if d is SPARK else "chr(10)"


def _vehicle(d: Dialect) -> str:
    return f"""SELECT c_custkey AS vehicle_id, vin, c_nationkey AS fleet_id, 1 + c_custkey % 5 AS oem_id,
           c_mktsegment AS model,
           CASE c_custkey % 4 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' WHEN 2 THEN 'hybrid' ELSE 'electric' END AS fuel_type,
           c_acctbal >= -500 AS registered
           FROM ({_vin_chain('customer', '(c_custkey + 1)')}) v"""


def _alert(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS alert_id, o_custkey AS vehicle_id, 1 + o_orderkey % 5 AS alert_type_id,
           CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'ack' ELSE 'closed' END AS status,
           CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'critical'
                WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'warning' ELSE 'info' END AS severity,
           {d.epoch_ms('o_orderdate')} AS raised_ms, {d.ts(d.epoch_ms('o_orderdate'))} AS raised_at
           FROM orders"""


def _alert_type(d: Dialect) -> str:
    return """SELECT DISTINCT 1 + o_orderkey % 5 AS alert_type_id,
           CASE o_orderkey % 5 WHEN 0 THEN 'IDLING_EXCESSIVE' WHEN 1 THEN 'HARSH_BRAKE_BURST'
                WHEN 2 THEN 'DTC_REPEAT' WHEN 3 THEN 'OVERSPEED_ANOMALY' ELSE 'LOW_FUEL' END AS code FROM orders"""


def _driver(d: Dialect) -> str:
    return f"""SELECT s_suppkey AS driver_id, n_regionkey AS tenant_id, s_name AS full_name,
           'TN' || lpad(CAST(s_suppkey AS STRING), 8, '0') AS licence_no,
           CASE WHEN s_acctbal < -500 THEN {d.ts(str(BASE_MS))} END AS erased_at
           FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _assignment(d: Dialect) -> str:
    change = BASE_MS + 14 * 86400000
    return f"""SELECT c_custkey AS vehicle_id, c_custkey % 10 AS driver_id, {d.ts(str(BASE_MS))} AS assigned_from,
           {d.ts(str(change))} AS assigned_to FROM customer
    UNION ALL
    SELECT c_custkey, (c_custkey + 3) % 10, {d.ts(str(change))}, NULL FROM customer WHERE c_acctbal >= 0"""


def _audit_log(d: Dialect) -> str:
    return """SELECT event_id AS audit_id, user_id % 5 AS tenant_id, user_id, event_type AS action,
           CASE WHEN k % 10 = 0 THEN 403 ELSE 200 END AS status, ms AS at_ms FROM event_rows"""


def _mapping_docs(d: Dialect) -> str:
    """One mapping document per part: the brand is the vendor, the part key the version."""
    return """SELECT upper(replace(p_brand, '#', CASE WHEN p_size = 50 THEN '#' ELSE '-' END)) AS oem,
           CAST(p_partkey + 1 AS INT) AS version, p_size > 25 AS active, p_partkey AS arrival,
           p_size, p_retailprice / 1000 AS price FROM part"""


def _mapping_fields(d: Dialect) -> str:
    rows = []
    for i, name in enumerate(
        ("vin", "ts", "lat", "lon", "speed_kmh", "odo_km", "seq", "fuel_pct", "engine_on", "rpm", "dtc", "evt")
    ):
        path = f"CASE WHEN p_size = {i + 1} THEN '' ELSE 'body.{name}' END"
        unit = {
            "speed_kmh": "CASE WHEN p_size = 21 THEN 'knots' ELSE 'mph' END",
            "odo_km": "CASE WHEN p_size = 22 THEN 'league' ELSE 'mi' END",
        }.get(name, "CAST(NULL AS STRING)")
        scale = "CASE WHEN p_size = 23 THEN -price ELSE price END" if name == "fuel_pct" else "CAST(NULL AS DOUBLE)"
        form = "CASE WHEN p_size = 24 THEN 'unix' ELSE 'epoch_s' END" if name == "ts" else "CAST(NULL AS STRING)"
        split = "CASE WHEN p_size = 25 THEN '----' ELSE ';' END" if name == "dtc" else "CAST(NULL AS STRING)"
        rows.append(
            f"SELECT oem, version, active, arrival, {i} AS pos, '{name}' AS field, {path} AS path, {unit} AS unit,"
            f" {scale} AS scale, {form} AS format, {split} AS split FROM mapping_docs WHERE p_size <> {30 + i}"
        )
    return " UNION ALL ".join(rows)


VIEWS: dict[str, tuple[tuple[str, ...], Callable[[Dialect], str]]] = {
    "event_rows": ((), _event_rows),
    "telemetry": (("event_rows",), _telemetry),
    "telemetry_fast": (("telemetry",), _telemetry_fast),
    "telemetry_sparse": (("telemetry",), _telemetry_sparse),
    "arrivals": (("telemetry",), _arrivals),
    "wire": (
        ("arrivals",),
        lambda d: _wire(d, "SELECT *, CAST(NULL AS INT) AS defect FROM arrivals"),
    ),
    "wire_defects": (("arrivals",), lambda d: _wire(d, _defects())),
    "batches": (("wire_defects",), _batches),
    "tenant": ((), lambda d: "SELECT r_regionkey AS tenant_id, r_name AS name FROM region"),
    "fleet": (
        (),
        lambda d: "SELECT n_nationkey AS fleet_id, n_regionkey AS tenant_id, n_name AS name FROM nation",
    ),
    "vehicle": ((), _vehicle),
    "oem": (
        (),
        lambda d: "SELECT DISTINCT 1 + c_custkey % 5 AS oem_id,"
        " substr('ABCDE', CAST(1 + c_custkey % 5 AS INT), 1) AS code FROM customer",
    ),
    "alert": ((), _alert),
    "alert_type": ((), _alert_type),
    "driver": ((), _driver),
    "assignment": ((), _assignment),
    "audit_log": (("event_rows",), _audit_log),
    "mapping_docs": ((), _mapping_docs),
    "mapping_fields": (("mapping_docs",), _mapping_fields),
}


def _closure(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> list[str]:
    """The views that ``names`` build on, in order; those in ``stop`` are not looked into."""
    out: list[str] = []

    def visit(name: str, top: bool) -> None:
        if top or name not in stop:
            for dep in VIEWS[name][0]:
                visit(dep, False)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name, True)
    return out


def chain(dialect: Dialect, *names: str) -> list[str]:
    return [f"{n} AS ({VIEWS[n][1](dialect)})" for n in _closure(names)]


def duck(*names: str, then: str) -> str:
    """SQL check text: the named views, then further CTEs and the final SELECT (``then``)."""
    ctes = ",\n".join(chain(DUCK, *names))
    joint = "," if then.lstrip().startswith("+") else ""
    return f"WITH RECURSIVE {ctes}{joint}\n{then.lstrip().lstrip('+')}"


# Views kept as tables, as a landing zone keeps them: the vendor text and the decoded events.
LANDED = ("telemetry", "arrivals", "wire_defects", "vehicle")
#: Rows of a landed file, as far as there are enough of them for every task slot and at most PARTS files for each.
ROWS, PARTS = 50_000, 4
_landed: dict[tuple[str, str, str], str] = {}


def _landing(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a landed view, written on first use in this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = shared_dir(spark, name)
        rows = _inline(spark, sf_dir, name)
        tasks = spark.sparkContext.defaultParallelism
        parts = max(tasks, min(PARTS * tasks, rows.count() // ROWS))
        if rows.rdd.getNumPartitions() < parts:  # a small input file is one split, a large one a few; spread it once
            rows = rows.repartition(parts)
        rows.write.parquet(path)
        _landed[key] = path
    return _landed[key]


def _inline(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    names, kept = [], []
    for n in _closure((name,), stop=LANDED):
        if n in LANDED and n != name:
            kept.append(f"{n} AS (SELECT * FROM parquet.`{_landing(spark, sf_dir, n)}`)")
        else:
            names.append(f"{n} AS ({VIEWS[n][1](SPARK)})")
    text = ",\n".join(names)
    sources = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if f" {t}" in text]
    return spark.sql("WITH " + ",\n".join(sources + kept + names) + f"\nSELECT * FROM {name}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; landed views are scanned from their table."""
    configure(spark)
    if name in LANDED:
        return spark.read.parquet(_landing(spark, sf_dir, name))
    return _inline(spark, sf_dir, name)
