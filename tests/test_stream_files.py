"""Steps of arrivals as files: written side by side, read one step per batch."""
from pyspark.sql import functions as F

from tapeworks.plans import streams as Q


def batches(stream, cp, value):
    seen = []
    def each(batch, n):
        seen.append(sorted(r[0] for r in batch.select(value).collect()))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_a_step_is_one_batch_of_many_files(spark, tmp_path):
    for rows in (5, 900):  # five rows fill fewer files than there are cores
        path = f"{tmp_path}/parts-{rows}"
        df = spark.range(rows).withColumn("us", F.col("id") * 10)
        files = Q.write_parts(df, path, "us", 3)
        got = batches(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path), f"{tmp_path}/cp-{rows}", "id")
        assert len(got) == 3 and sum(got, []) == list(range(rows)) and all(got)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 3 * files > 3


def test_lines_arrive_by_kind(spark, tmp_path):
    path = f"{tmp_path}/lines"
    df = spark.range(300).select(F.element_at(F.array(F.lit("in time"), F.lit("late"), F.lit("replay")), (F.col("id") % 3 + 1).cast("int")).alias("o"), F.col("id").cast("string").alias("value"))
    files = Q.write_lines(df.where("o <> 'late' or value = '1'"), path)
    got = batches(spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(path), f"{tmp_path}/cp", F.col("value").cast("int"))
    assert [{i % 3 for i in b} for b in got] == [{0}, {1}, {2}] and [len(b) for b in got] == [100, 1, 100]
