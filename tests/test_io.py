import json

import pytest
from pyspark.sql import functions as F

from tarnbridge.sources import files, sinks
from tarnbridge.streaming.incremental import ingest, latest_by_key, windowed_counts


def test_json_layouts(spark, tmp_path):
    schema = "a int, b string"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "y"}\n')
    (tmp_path / "list.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "one.json").write_text('{"a": 5}')
    (tmp_path / "wrapped.json").write_text('{"articles": [{"a": 1}, {"a": 2}, {"a": 3}]}')
    count = lambda name, **kw: sorted(r["a"] for r in files.json_records(spark, str(tmp_path / name), schema, **kw).collect())
    assert count("x.jsonl") == [1, 2] and count("list.json") == [1, 2] and count("one.json") == [5]
    assert count("wrapped.json", wrapper="articles") == [1, 2, 3] and count("list.json", wrapper="articles") == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a"')
    with pytest.raises(Exception, match="(?i)malformed|failfast|FAILED_READ"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_listed_and_snapshot(spark, tmp_path):
    (tmp_path / "races.txt").write_text("# names\n\nOne\n  Two \n#x\n")
    assert [r["value"] for r in files.listed(spark, str(tmp_path / "races.txt")).collect()] == ["One", "Two"]
    rows = spark.createDataFrame([("a_20240101_000000.json", 1), ("b_20240301_000000.json", 0), ("z.json", 9)], "path string, modified int")
    assert tuple(files.latest_snapshot(rows).collect()[0]) == ("b_20240301_000000.json", "20240301_000000")
    assert files.files_in(spark, str(tmp_path), "*.txt").count() == 1


def test_qrels_beyond_63_bits(spark):
    rows = spark.createDataFrame([("q", ["16976417767098962956"], 1), ("q", ["5"], 2), ("r", None, 1), ("s", ["16976417767098962956"], 1)], "qid string, relevant_ids array<string>, o int")
    assert {r["qid"]: [int(x) for x in r["relevant_ids"]] for r in files.qrels(rows, "o").collect()} == {"q": [5], "r": [], "s": [16976417767098962956]}


def test_config():
    assert files.config('{"a": 1}', {"a"}) == {"a": 1}
    with pytest.raises(ValueError):
        files.config('{"b": 1}', {"a"})


def test_swap_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.read.parquet(path).unionAll(spark.range(10, 12)), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 10, 11]
    assert sinks.write_snapshot(spark.range(2), str(tmp_path / "s"), "r1") and not sinks.write_snapshot(spark.range(0), str(tmp_path / "s"), "r2")
    sinks.write_json(spark.range(2), str(tmp_path / "log"))
    sinks.write_json(spark.range(2), str(tmp_path / "log"), append=True)
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_grounding_and_checks(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 5)], "q int, o int, name string, age int")
    payload = sinks.grounding(rows, ["q"], "o", ["name", "age"]).collect()[0]["payload"]
    assert json.loads(payload) == [{"name": "a", "age": 5}, {"name": "b"}]
    good = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert sinks.checked_vectors(good, 2).count() == 1
    with pytest.raises(ValueError):
        sinks.checked_vectors(good, 3)


def test_incremental_equals_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    merge = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
    schema = "id bigint, ts timestamp, kind string, value double"
    rows.filter("id < 60").write.parquet(folder)
    ingest(spark, folder, "*.parquet", schema, str(tmp_path / "cp"), merge)
    rows.filter("id >= 60").write.mode("append").parquet(folder)
    ingest(spark, folder, "*.parquet", schema, str(tmp_path / "cp"), merge)
    ingest(spark, folder, "*.parquet", schema, str(tmp_path / "cp"), merge)
    got = spark.read.parquet(out)
    assert got.count() == 100 and got.select("batch").distinct().count() == 2
    count = lambda df: sorted(map(tuple, windowed_counts(df, "ts", "1 day", "1 day", "kind").select("w.start", "kind", "n", "value").collect()))
    assert count(got.drop("batch")) == count(rows)
    last = latest_by_key(spark.readStream.schema(schema).parquet(folder), "kind", "ts", F.col("id") < 90)
    held = {}
    query = last.writeStream.outputMode("update").foreachBatch(lambda df, _: held.update({r["kind"]: r["id"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp2"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert held == {"0": 87, "1": 88, "2": 89} == {r["kind"]: r["id"] for r in latest_by_key(rows, "kind", "ts", F.col("id") < 90).collect()}
    rows.filter("id = 3").withColumn("ts", F.timestamp_seconds(F.lit(10**9))).write.mode("append").parquet(folder)
    query.trigger(availableNow=True).start().awaitTermination()
    assert held == {"0": 3, "1": 88, "2": 89}
    assert latest_by_key(rows, "kind", "ts").columns == rows.columns


def test_small_sources_and_sinks(spark, tmp_path):
    paths = spark.createDataFrame([("a.json",), ("b.jsonl",), ("c.txt",)], "path string")
    assert files.last_named(paths).collect()[0]["path"] == "b.jsonl"
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert tuple(sinks.dry_run(rows, "id", "v").collect()[0]) == (2, 2, 1)
    sinks.append_log(rows, str(tmp_path / "log"), F.col("v").isNotNull())
    assert [r["id"] for r in spark.read.json(str(tmp_path / "log")).collect()] == [2]
    assert files.first_rows(rows, "id", 1).count() == 1 and files.first_rows(rows, "id", None).count() == 2
    assert spark.range(1).select(files.run_id(F.timestamp_seconds(F.lit(0)))).collect()[0][0] == "19700101_000000"
