"""Reading, writing and checking of tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from gapwise.operators import checks
from gapwise.operators.normalize import Limits, json_clean, normalize
from gapwise.ordered import Axis
from gapwise.sources import tables


def fresh_path():
    return tempfile.mkdtemp(prefix="gapwise-test-") + "/table"


def test_write_never_replaces(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "session_id string, frame int, v double")
    path = fresh_path()
    tables.write_session(df, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="exists"):
        tables.write_session(df, path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("bad", (float("nan"), float("inf")))
def test_write_refuses_non_finite(spark, bad):
    df = spark.createDataFrame([("a", bad)], "session_id string, v double")
    with pytest.raises(ValueError):
        tables.write_session(df, fresh_path())
    assert json_clean(df).first().v is None


def test_legacy_records_keep_doubtful_values(spark):
    path = fresh_path()
    header = ",".join(("session_id", *tables.LEGACY_COLUMNS, "quality_hint"))
    lines = [
        "s,1,0.00,3,1:30.5,50.0,,4,10,0,0.1,0,,s:held;speed_kmh:held",
        "s,2,0.02,3,1:30.5,101.0,682,4,120,0,-2,1,0,",
    ]
    spark.createDataFrame([(header,), *[(line,) for line in lines]], "value string").coalesce(
        1
    ).write.text(path)
    raw = spark.read.csv(path, header=True)
    rows = sorted(normalize(raw, Limits()).collect(), key=lambda r: r.frame)
    assert rows[0].s == 0.5 or rows[0].s is None
    first, second = rows
    assert first.lap_time_s == 90.5 and first.speed_kmh is None and first.tc_active is False
    assert first.abs_active is None and first.field_quality["speed_kmh"] == "held"
    assert second.speed_kmh == 682 and second.field_quality["speed_kmh"] == "anomalous"
    assert second.throttle_pct == 120 and second.field_quality["steering"] == "anomalous"
    assert "speed_kmh outside [0, 400]" in second.anomalies


def test_clock_and_interval_violations(spark):
    rows = [(0, 0, 0.0), (0, 1, 0.1), (0, 3, 0.3), (0, 4, 0.5), (0, 4, 0.4)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "session_id int, frame int, time_s double, o int")
    found = checks.check_clock(df, Axis(("session_id",), ("o",)), 0.1)
    assert {r.rule for r in found.collect()} == {"cadence", "frame_not_increasing", "time_not_increasing"}
    with pytest.raises(ValueError):
        checks.assert_none(found)
    spans = spark.createDataFrame(
        [(0, "brake", 0.0, 2.0, "r"), (0, "brake", 1.0, 3.0, " "), (0, "brake", 4.0, 4.0, "r")],
        "session_id int, field string, start_s double, end_s double, reviewer string",
    )
    rules = sorted(r.rule for r in checks.check_intervals(spans, ("session_id",)).collect())
    assert rules == ["blank_reviewer", "not_ordered", "overlap"]


def test_hash_check_reports_each_kind(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    manifest = files.filter("id < 3").select("id", F.sha2("text", 256).alias("sha256"))
    manifest = manifest.withColumn("sha256", F.when(F.col("id") == 2, "x").otherwise(F.col("sha256")))
    manifest = manifest.unionByName(spark.createDataFrame([(4, "y")], "id int, sha256 string"))
    got = {(r.key, r.rule) for r in checks.check_hashes(files, manifest, "id", "text").collect()}
    assert got == {("2", "integrity_mismatch"), ("3", "not_recorded"), ("4", "missing_payload")}
