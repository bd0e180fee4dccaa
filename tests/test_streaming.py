from pyspark.sql import functions as F

from paleoframe.operators.profile import mismatch_counts
from paleoframe.operators.reads import eligible, end_bases
from paleoframe.sources.derived import reads, with_bases
from paleoframe.streaming.live import live_counts


def test_a_stream_gives_the_counts_of_the_batch(spark, tmp_path):
    events = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"))
    aligned = with_bases(reads(events))
    aligned.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(aligned.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    try:
        q.processAllAvailable()
        want = mismatch_counts(end_bases(eligible(aligned)))
        assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, want.collect()))
    finally:
        q.stop()
