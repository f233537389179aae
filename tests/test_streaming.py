"""The streamed circuit ends in the state of the batch fold."""

from melder.operators.state import circuit
from melder.streaming.health import circuit_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, i % 3 == 0 or i % 7 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "source long, t string, seq long, failed boolean").selectExpr("source", "cast(t as timestamp) as ts", "seq", "failed")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = circuit_stream(stream).writeStream.format("memory").queryName("circuits").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["source", "calls", "allowed", "failures", "state", "generation"]
    got = {tuple(r[c] for c in cols) for r in spark.sql("select * from circuits").collect()}
    assert got == {tuple(r[c] for c in cols) for r in circuit(df).collect()}
