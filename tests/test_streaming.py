from pyspark.sql import functions as F

from jobmarket.streaming import observations as stream


def test_sightings_merge_by_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "url string, observed_at timestamp"
    rows = [("https://x.test/a?utm_source=1", "2024-01-02"), ("https://x.test/a", "2024-01-01"), ("https://x.test/b", "2024-01-05")]
    for r in rows:
        spark.createDataFrame([r], "url string, d string").select("url", F.to_timestamp("d").alias("observed_at")).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.write_sightings(source, str(tmp_path / "state"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["source_url"]: (str(r["first_seen_at"])[:10], str(r["last_seen_at"])[:10], r["n"]) for r in stream.read_sightings(spark, str(tmp_path / "state")).collect()}
    assert got == {"https://x.test/a": ("2024-01-01", "2024-01-02", 2), "https://x.test/b": ("2024-01-05", "2024-01-05", 1)}
    batch = spark.read.parquet(path).limit(1)
    stream.merge_batches(str(tmp_path / "state"))(batch, 2)
    stream.merge_batches(str(tmp_path / "state"))(batch, 2)
    assert stream.read_sightings(spark, str(tmp_path / "state")).agg(F.sum("n")).first()[0] == 3


def test_first_arrivals(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("https://x.test/a?utm_source=1", "2024-01-01"), ("https://x.test/a", "2024-01-01"), ("https://x.test/b", "2024-01-01")], "url string, d string").select("url", F.to_timestamp("d").alias("arrived_at")).write.parquet(path)
    q = stream.first_arrivals(spark.readStream.schema("url string, arrived_at timestamp").parquet(path)).writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["source_url"] for r in spark.table("arrivals").collect()) == ["https://x.test/a", "https://x.test/b"]


def test_status_stream(spark, tmp_path):
    stream.use_state_store(spark)
    path = str(tmp_path / "in")
    schema = "id long, vacancy_source_url string, new_status string, kind string, reason string"
    for rows in ([(1, "u", "Applied", "normal", ""), (2, "u", "Offer", "normal", "")], [(3, "u", "Saved", "corrective", "oops"), (4, "v", "Interview", "normal", "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    q = stream.status_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.format("memory").queryName("verdicts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {r["id"]: (r["previous_status"], r["verdict"]) for r in spark.table("verdicts").collect()} == {1: ("Saved", "accepted"), 2: ("Applied", "not_allowed"), 3: ("Applied", "accepted"), 4: ("Saved", "accepted")}
