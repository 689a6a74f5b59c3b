"""Error records that arrive in a folder are logged once."""

from normgraph import streaming


def test_error_log(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.json").write_text('{"message":"m","source":"s","lineno":3}\nbroken\n')
    streaming.write_error_log(streaming.error_stream(spark, str(inbox)), out, state, "t").awaitTermination()
    (inbox / "b.json").write_text('{"message":"n"}\n')
    streaming.write_error_log(streaming.error_stream(spark, str(inbox)), out, state, "t").awaitTermination()
    assert sorted(r.value for r in spark.read.text(out).collect() if r.value) == ["  Location: s:3", *["=" * 50] * 3, "[t] ERROR: Unknown Error", "[t] ERROR: m", "[t] ERROR: n"]
