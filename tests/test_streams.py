"""Streams: sessions are dealt to buckets, each one call and one state row per micro-batch."""

from pyspark.sql import functions as F

from gapwise.streaming import causal

SESSIONS = 3000


def arrive(spark, folder, rows):
    """Append the rows to the source and run the stream over them; returns its state rows and output."""
    rows.coalesce(2).write.mode("append").parquet(f"{folder}/in")
    found = causal.stream_last_observed(causal.observation_stream(spark, f"{folder}/in", rows.schema))
    writer = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    query = writer.trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.numInputRows]
    return state[-1], spark.read.schema(found.schema).parquet(f"{folder}/out")


def test_sessions_share_calls_and_keep_their_own_state(spark, tmp_path):
    """Two arrivals, null sessions and fields among them, against a plain loop."""
    session = F.when(F.col("id") % SESSIONS != 7, F.col("id") % SESSIONS + 2**60)
    rows = spark.range(SESSIONS * 4).select(
        session.alias("session_id"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("f"), F.col("id") % 2)).alias("field"),
        F.floor(F.col("id") / SESSIONS).alias("frame"),
        (F.col("id") / 2).alias("time_s"),
        F.when(F.col("id") % 3 == 0, "missing").otherwise("observed").alias("quality"),
    )
    arrive(spark, str(tmp_path), rows.filter("frame < 2"))
    state, out = arrive(spark, str(tmp_path), rows.filter("frame >= 2"))
    seen, expected = {}, set()
    for r in sorted(rows.collect(), key=lambda r: r.frame):
        key = r.session_id, r.field
        seen[key] = r.time_s if r.quality == "observed" else seen.get(key)
        expected.add((*key, r.frame, r.time_s, seen[key]))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert state < len(seen)
