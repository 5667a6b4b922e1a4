"""The evaluation numbers a recording once, and counts before it cuts a key."""

import __spark_entry__ as entry
from gapwise.bindings.views import Views
from gapwise.ordered import exceeds_task
from gapwise.plans import jobs

FOLDER = "/root/testdata/sf0.001"


def test_a_kept_signal_is_the_same_without_the_scan(spark):
    plain, kept = Views(spark, FOLDER), Views(spark, FOLDER).kept()
    plans = [v.sig._jdf.queryExecution().analyzed().toString() for v in (plain, kept)]
    assert ["parquet" in p for p in plans] == [True, False]
    assert sorted(map(str, plain.sig.collect())) == sorted(map(str, kept.sig.collect()))


def test_a_key_beyond_a_task_is_seen(spark, group_rows):
    signal = Views(spark, FOLDER).table("events")
    group_rows(9)
    assert exceeds_task(signal, ("user_id",))
    group_rows(2_000_000)
    assert not exceeds_task(signal, ("user_id",))


def test_progress_is_fused_from_kept_rows(spark, monkeypatch):
    given, plain = [], jobs.fusion.track_progress

    def track(rows, *settings):
        given.append(rows._jdf.queryExecution().analyzed().toString())
        return plain(rows, *settings)

    monkeypatch.setattr(jobs.fusion, "track_progress", track)
    entry.queries()["progress_job"](spark, FOLDER)
    assert len(given) == 1 and "parquet" not in given[0]
