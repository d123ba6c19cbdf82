"""The ledger state of a stream equals the batch result."""

from perinuc.operators.ledger import ledger_state
from perinuc.streaming.ledger import read_events, write_state

SCHEMA = "event_id int, ts int, channel string, fov_id string, ne_label string, event string, attribute string, value string, metric double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, (i * 7) % 50, "ch1", "1", "ab"[i % 2], "e", ("registration", "paired")[i % 3 == 0], f"v{i}", 0.0) for i in range(50)]
    events = spark.createDataFrame(rows, SCHEMA)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = write_state(read_events(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.awaitTermination(60)
    state = spark.read.parquet(str(tmp_path / "out"))
    last = state.filter(state.batch == state.agg({"batch": "max"}).first()[0]).drop("batch")
    assert sorted(last.collect(), key=str) == sorted(ledger_state(events).collect(), key=str)
