"""Dead letters by vendor and version: an activation re-reads what it can change, once."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from convoy.operators import routing
from convoy.plans.fixtures import view
from convoy.schemas import VENDOR_MAPPINGS
from convoy.session import shared_dir
from convoy.sources import batches, ndjson, rejects

SF = "/root/testdata/sf0.001"
B = VENDOR_MAPPINGS["B"]


def registry(**versions):
    """Documents of B's form for the named vendors; version 1 reads the speed from a key that is not there."""
    slow = {**B, "speed_kmh": {"path": "pace", "unit": "kmh"}}
    return {oem: {"version": v, "fields": slow if v == 1 else B} for oem, v in versions.items()}


@pytest.fixture(scope="module")
def fleet(spark):
    return view(spark, SF, "vehicle").filter("registered"), view(spark, SF, "fleet")


@pytest.fixture()
def stored(spark, fleet):
    vin = fleet[0].agg(F.min("vin")).first()[0]
    doc = {"vin": vin, "ts": "2024-01-02T00:00:00Z", "gps": [1, 2], "speed_kmh": 5, "odo_km": 9, "engine_on": True, "seq": 1}
    rows = [(oem, json.dumps({**doc, "seq": i}), dt.datetime(2024, 1, 2)) for i, oem in enumerate("BBBCC")]
    rows += [("B", "not json", dt.datetime(2024, 1, 2)), ("no/vendor", json.dumps(doc), dt.datetime(2024, 1, 2)), (None, None, None)]
    raw = spark.createDataFrame(rows, "oem string, line string, received_at timestamp")
    path = shared_dir(spark, "rejects")
    routed = routing.route(ndjson.classify_lines(raw), registry(B=1), *fleet)
    rejects.store_rejects(routed.filter("reason IS NOT NULL"), 0, path, registry(B=1))
    return path, shared_dir(spark, "accepted")


def parts(spark, path):
    out = {}
    for e in batches.live(spark, path):
        out[e.part] = out.get(e.part, 0) + e.rows
    return out


def test_letters_lie_by_vendor_and_version(spark, stored):
    assert parts(spark, stored[0]) == {"B~1": 4, "C~0": 2, "none": 2}


def test_an_activation_reads_its_vendor_only_and_once(spark, stored, fleet):
    path, accepted = stored
    others = {e.folder for e in batches.live(spark, path) if not e.part.startswith("B")}
    assert rejects.replay_changed(spark, path, accepted, registry(B=1), *fleet).count() == 0
    read = rejects.replay_changed(spark, path, accepted, registry(B=2), *fleet)
    assert [tuple(r) for r in read.collect()] == [("B~1", 4)]
    assert sorted(r.seq for r in batches.read_batches(spark, accepted).collect()) == [0, 1, 2]
    assert parts(spark, path) == {"B~2": 1, "C~0": 2, "none": 2}
    assert others <= {e.folder for e in batches.live(spark, path)}
    assert rejects.replay_changed(spark, path, accepted, registry(B=2), *fleet).count() == 0
    assert batches.read_batches(spark, accepted).count() == 3
    rejects.replay_changed(spark, path, accepted, registry(B=2, C=2), *fleet)
    assert parts(spark, path) == {"B~2": 1, "none": 2} and batches.read_batches(spark, accepted).count() == 5


def test_a_replay_that_broke_off_is_finished_without_doubles(spark, stored, fleet, monkeypatch):
    path, accepted = stored

    def fail(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(rejects, "store_rejects", fail)  # the accepted rows are stored, the letters are not exchanged
        with pytest.raises(OSError):
            rejects.replay_changed(spark, path, accepted, registry(B=2), *fleet)
    assert parts(spark, path)["B~1"] == 4
    rejects.replay_changed(spark, path, accepted, registry(B=2), *fleet)
    assert batches.read_batches(spark, accepted).count() == 3 and parts(spark, path) == {"B~2": 1, "C~0": 2, "none": 2}
