"""No event type is left out, however many there are."""

from wavemill import queries as Q


def test_every_event_type(spark, tmp_path):
    rows = [(1, f"t{i:04}") for i in range(1100)] + [(2, "t0000")]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in Q.QUERIES["missing_types"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(2, f"t{i:04}") for i in range(1, 1100)]
