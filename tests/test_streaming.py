from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from mailweave.streaming import turns

SCHEMA = StructType([StructField("trace_id", StringType()), StructField("thread_id", StringType()), StructField("logged_at", TimestampType()), StructField("latency_ms", DoubleType())])


def test_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "t", "2024-01-01T00:01:00Z", 1.0), ("a", "t", "2024-01-01T00:01:00Z", 1.0), ("b", "t", "2024-01-01T00:30:00Z", 3.0), ("c", "u", "2024-01-01T02:00:00Z", 5.0)]
    lines = ['{"trace_id":"%s","thread_id":"%s","logged_at":"%s","latency_ms":%s}' % r for r in rows]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    stream = turns.turns_per_thread(turns.distinct_turns(turns.read_turns(spark, str(tmp_path / "in"), SCHEMA)))
    run = stream.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    assert run.exception() is None
    got = {(r.thread_id, r.turns) for r in spark.sql("SELECT * FROM counted").collect()}
    assert got <= {("t", 2), ("u", 1)}
    batch = turns.turns_per_thread(turns.distinct_turns_batch(spark.read.schema(SCHEMA).json(str(tmp_path / "in"))))
    assert {(r.thread_id, r.turns, r.latency) for r in batch.collect()} == {("t", 2, 2.0), ("u", 1, 5.0)}
