import pytest
from pyspark.sql import functions as F

from tarnbridge.streaming.expiring import fresh_by_key, keyed_state
from tarnbridge.streaming.upserts import UpsertTable


@pytest.fixture
def known(spark, tmp_path):
    return UpsertTable(spark, str(tmp_path / "table"), ["id"], lambda: F.col("rank"), keep=["born"], stamp={"stamp": F.lit("now")}, buckets=4)


SCHEMA = "id int, rank int, born string, v string, stamp string"


def rows_of(table):
    return sorted((r["id"], r["born"], r["v"]) for r in table.read().collect())


def test_batches_insert_update_and_keep(spark, known):
    assert known.read() is None
    known.merge(spark.createDataFrame([], SCHEMA), 0)
    assert known.read() is None and known.batches() == [0]
    known.merge(spark.createDataFrame([(1, 0, "a", "x", None), (1, 1, "b", "y", None), (2, 0, "c", None, None)], SCHEMA), 1)
    assert rows_of(known) == [(1, "b", "y"), (2, "c", None)]
    known.merge(spark.createDataFrame([(2, 0, "d", "z", None), (3, 0, "e", "w", None)], SCHEMA), 2)
    assert rows_of(known) == [(1, "b", "y"), (2, "c", "z"), (3, "e", "w")]
    assert {r["stamp"] for r in known.read().collect()} == {"now"} and known.batches() == [0, 1, 2]


def test_a_replayed_batch_changes_nothing(spark, known):
    rows = spark.createDataFrame([(1, 0, "a", "x", None)], SCHEMA)
    known.merge(rows, 0)
    known.merge(spark.createDataFrame([(1, 0, "a", "later", None)], SCHEMA), 1)
    known.merge(rows, 0)  # handed over again
    known.merge(spark.createDataFrame([(1, 0, "a", "other", None)], SCHEMA), 1)
    assert rows_of(known) == [(1, "a", "later")]


def test_a_batch_that_failed_before_it_was_published(spark, known, monkeypatch):
    known.merge(spark.createDataFrame([(1, 0, "a", "x", None)], SCHEMA), 0)
    second = spark.createDataFrame([(1, 0, "a", "y", None), (2, 0, "b", "z", None)], SCHEMA)

    def broken(entry, batch):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(known, "_publish", broken)
        with pytest.raises(OSError):
            known.merge(second, 1)
    assert rows_of(known) == [(1, "a", "x")] and known.batches() == [0]  # readers see nothing of it
    known.merge(second, 1)
    assert rows_of(known) == [(1, "a", "y"), (2, "b", "z")]


def test_only_buckets_with_changes_are_written(spark, known, tmp_path):
    known.merge(spark.createDataFrame([(i, 0, "a", "x", None) for i in range(40)], SCHEMA), 0)
    known.merge(spark.createDataFrame([(7, 0, "a", "y", None)], SCHEMA), 1)
    assert len(list((tmp_path / "table" / "data" / "batch=1").glob("_bucket=*"))) == 1
    assert len(rows_of(known)) == 40 and (7, "a", "y") in rows_of(known)


LOG = "k string, ts timestamp, id bigint, v double"


def test_fresh_rows_by_key_and_bounded_state(spark, tmp_path):
    """Keys come once, or again and again; what is fresh at the end is what a batch says; keys that expired leave no state."""
    rows = [(f"k{i}", i * 60, i, 1.0) for i in range(200)] + [("often", i * 600, 1000 + i, 1.0) for i in range(21)] + [("never", 100, 5000, -1.0), (None, 100, 6000, 1.0), ("tie", 11_990, 1, 1.0), ("tie", 11_990, 3, 1.0), ("tie", 11_990, 2, 1.0)]
    log = spark.createDataFrame(rows, "k string, at bigint, id bigint, v double").select("k", F.timestamp_seconds("at").alias("ts"), "id", "v")
    folder, ttl = str(tmp_path / "in"), 1800
    known = UpsertTable(spark, str(tmp_path / "table"), ["k"], lambda: F.struct("fresh", "ts", "id"), buckets=2)
    most = 0
    with keyed_state(spark):
        for low in range(0, 12_001, 3000):
            log.filter(F.unix_seconds("ts").between(low, low + 2999)).coalesce(1).write.mode("append").parquet(folder)
            changes = fresh_by_key(spark.readStream.schema(LOG).parquet(folder), "k", "ts", "id", ttl, valid=F.col("v") > 0)
            query = changes.writeStream.outputMode("update").foreachBatch(known.merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
            most = max([most, *(o.numRowsTotal for o in query.lastProgress.stateOperators)])
    last, newest = {}, 12_000
    for k, at, i, v in rows:
        if k and v > 0:
            last[k] = max(last.get(k, (-1, -1)), (at, i))
    want = sorted((k, i) for k, (at, i) in last.items() if at + ttl > newest)
    assert sorted((r["k"], r["id"]) for r in known.read().filter("fresh").collect()) == want and ("tie", 3) in want
    # a row of state a fresh key, and two of its timer: never those of all 202 keys
    assert most <= 3 * (3000 // 60 + ttl // 60 + 4)
