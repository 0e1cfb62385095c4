from datetime import datetime, timedelta

from lamina.streaming import frames


def test_frames_stream_like_a_batch(spark, tmp_path):
    rows = [(t, z, x, float(t + z * x), datetime(2024, 1, 1) + timedelta(minutes=t)) for t in range(6) for z in range(2) for x in range(4)]
    batch = spark.createDataFrame(rows, frames.FRAME)
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    query = frames.intensities(frames.arriving(spark, str(tmp_path / "in"), 1), 20.0).writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("seen").collect()) == sorted(frames.intensities(batch, 20.0).collect())


def test_frame_statistics(spark, tmp_path):
    rows = [(t, 0, 0, float(t), datetime(2024, 1, 1) + timedelta(minutes=t)) for t in range(30)]
    spark.createDataFrame(rows, frames.FRAME).write.parquet(str(tmp_path / "in"))
    query = frames.frame_statistics(frames.arriving(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("windows").collect()) == 30
