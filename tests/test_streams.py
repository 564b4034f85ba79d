"""Streams over several micro-batches, with late rows, restarts and jobs that end in a merge."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliolens.functions import text as X
from foliolens.functions.register import register_functions
from foliolens.operators import events as E, exports, stats
from foliolens.session import new_folder
from foliolens.streaming import jobs
from foliolens.streaming.store import BatchStore

SCHEMA = "url string, ts timestamp, n int"


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def write(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{number:03}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_dedupe_over_batches_late_rows_and_a_restart(spark):
    folder = new_folder(spark, "test-dedupe")
    batches = [
        [("a", at(5), 1), ("b", at(6), 1), ("a", at(4), 2)],
        [("a", at(900), 3), ("c", at(1), 1), (None, at(2), 1)],
        [("b", at(0), 4), ("d", at(2000), 1), ("d", at(1999), 2)],
        [(None, at(3), 2), ("e", at(-50), 1)],
        [("e", at(-60), 2), ("f", at(7), 1), ("a", at(5), 1)],
    ]
    for number, rows in enumerate(batches[:3]):
        write(spark, folder, number, rows)
    jobs.stream_dedupe(source(spark, folder), f"{folder}/out")
    for number, rows in enumerate(batches[3:], 3):
        write(spark, folder, number, rows)
    found = {(r.url, r.n) for r in jobs.stream_dedupe(source(spark, folder), f"{folder}/out").collect()}
    # Files of one trigger may come in any order of their times; every key comes once, from its first batch.
    assert len(found) == len({url for url, _ in found}) == 7
    assert {("a", 2), ("b", 1), ("c", 1), ("d", 2), (None, 1), ("e", 1), ("f", 1)} == found
    again = jobs.stream_dedupe(source(spark, folder), f"{folder}/out")
    assert again.count() == 7 and again.columns == ["url", "ts", "n"]


def sums_store(spark, folder, fanout=3):
    def merged(parts):
        return parts.groupBy("k").agg(F.sum("n").alias("n"))

    return BatchStore(spark, folder, spark.createDataFrame([], "k string, n bigint").schema, merged, fanout=fanout)


def test_parts_are_merged_by_levels(spark):
    store = sums_store(spark, new_folder(spark, "test-store"))
    assert store.read().count() == 0
    for number in range(30):
        store.add(spark.createDataFrame([("a", 1), (f"b{number % 2}", number)], "k string, n bigint"), number)
        assert len(store.parts()) <= 2 * 4
    total = {r.k: r.n for r in store.merge(store.read()).collect()}
    assert total == {"a": 30, "b0": sum(range(0, 30, 2)), "b1": sum(range(1, 30, 2))}
    assert store.parts()[0][0] == 0 and store.parts()[-1][1] == 29
    # A batch that is run again changes nothing, merged or not.
    store.add(spark.createDataFrame([("a", 1), ("b0", 2)], "k string, n bigint"), 2)
    store.add(spark.createDataFrame([("a", 1), ("b1", 29)], "k string, n bigint"), 29)
    assert {r.k: r.n for r in store.merge(store.read()).collect()} == total


def test_a_job_that_ends_between_write_and_switch(spark, monkeypatch):
    folder = new_folder(spark, "test-crash")
    store = sums_store(spark, folder)
    for number in range(2):
        store.add(spark.createDataFrame([("a", 1)], "k string, n bigint"), number)
    write_part = BatchStore._write

    def ends(self, rows, part):
        write_part(self, rows, part)
        if part[1] > part[0]:
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(part)}/_SUCCESS")
            mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
            raise RuntimeError("lost")

    monkeypatch.setattr(BatchStore, "_write", ends)
    with pytest.raises(RuntimeError):
        store.add(spark.createDataFrame([("a", 1)], "k string, n bigint"), 2)
    assert store.parts() == [(0, 0), (1, 1), (2, 2)]
    monkeypatch.setattr(BatchStore, "_write", write_part)
    store.add(spark.createDataFrame([("a", 1)], "k string, n bigint"), 2)
    assert store.parts() == [(0, 2)] and store.read().first().n == 3


def test_merged_sums_equal_the_batch_twin(spark):
    folder = new_folder(spark, "test-rates")
    rows = [(i % 3, at(i / 40.0)) for i in range(200)]
    for number in range(10):
        spark.createDataFrame(rows[number::10], "user_id bigint, ts timestamp").coalesce(1).write.parquet(f"{folder}/in/{number:03}")
    stream = spark.readStream.schema("user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    found = jobs.stream_rate_audit(stream, f"{folder}/out", 0.01)
    twin = E.rate_audit(spark.createDataFrame(rows, "user_id bigint, ts timestamp"), 0.01)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, twin.collect()))


def test_attempts_without_an_outcome(spark):
    rows = [("s", True), ("s", False), ("s", None), ("t", None)]
    found = {r.source: tuple(r)[1:] for r in stats.source_success(spark.createDataFrame(rows, "source string, success boolean")).collect()}
    assert [int(x) for x in found["s"]] == [1, 1, 1, 2, 50] and [int(x or 0) for x in found["t"]] == [0, 0, 1, 0, 0]


def test_counts_past_the_largest_number(spark):
    register_functions(spark)
    texts = ["9223372036854775807", "9223372036854775808", "", None, "x", "1,2"]
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, t string")
    rows = sorted(frame.select("i", X.digits_count("t").alias("c"), F.expr("fl_digits_count(t)").alias("s")).collect())
    assert [r.c for r in rows] == [r.s for r in rows] == [2**63 - 1, None, 0, 0, 0, 12]


def test_csv_is_read_back_as_written(spark):
    path = new_folder(spark, "csv")
    rows = spark.createDataFrame([("1", 'say "hi", x'), ("2", "line\nbreak"), ("3", ""), ("4", " a\\b\t"), ("5", ",")], "id string, text string")
    exports.sink_csv(rows, path)
    assert sorted(map(tuple, exports.read_csv(spark, path, rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    exports.sink_csv(rows.limit(0), path + "-none")
    assert exports.read_csv(spark, path + "-none", rows.columns).count() == 0
