from kindred.operators.joiners import BucketLsh
from kindred.streaming.joins import join_batches


def test_batches_add_up_to_one_join(spark, tmp_path):
    schema = "id long, vector array<double>"
    rows = [(k, [float((k * p) % 11 - 5) for p in (1, 3, 7, 9)]) for k in range(60)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    joiner, seen = BucketLsh(0.2, 3, 20, 5, 3, salt_percentile=None), {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = join_batches(stream, df, joiner, lambda pairs, n: seen.update({n: pairs.collect()}))
    writer.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 1
    assert sorted(map(tuple, (r for rs in seen.values() for r in rs))) == sorted(map(tuple, joiner.join(df, df).collect()))
