from pyspark.sql import functions as F

from spanloom.streaming import ops


def write(spark, path, rows):
    spark.createDataFrame(rows, "id bigint, key string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def events(n, start=0):
    import datetime as d

    return [(start + k, f"k{k % 3}", d.datetime(2024, 1, 1) + d.timedelta(hours=6 * (start + k)), float(k)) for k in range(n)]


def test_scan_goes_on_where_it_stopped(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "check")
    write(spark, path, events(5))
    schema = spark.read.parquet(path).schema
    seen = []
    ops.drain(ops.scan(spark, path, schema), lambda b, n: seen.extend(r["id"] for r in b.collect()), check)
    assert sorted(seen) == [0, 1, 2, 3, 4]
    write(spark, path, events(3, 5))
    seen.clear()
    ops.drain(ops.scan(spark, path, schema), lambda b, n: seen.extend(r["id"] for r in b.collect()), check)
    assert sorted(seen) == [5, 6, 7]


def test_ledger_admits_a_key_once(spark, tmp_path):
    path, ledger, check = (str(tmp_path / x) for x in ("in", "ledger", "check"))
    for k in range(3):
        write(spark, path, events(4, k))
    s = ops.scan(spark, path, spark.read.parquet(path).schema, 1)
    add = ops.ledger_append(ledger, "key")
    ops.drain(s, add, check)
    keys = lambda: sorted(r["key"] for r in spark.read.parquet(ledger).collect())
    assert keys() == ["k0", "k1", "k2"]
    add(spark.read.parquet(path), 0)  # a repeated batch changes nothing
    assert keys() == ["k0", "k1", "k2"]


def test_quota_holds_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(4):
        write(spark, path, events(6, 6 * k))
    s = ops.scan(spark, path, spark.read.parquet(path).schema, 1)
    got = ops.collect_once(ops.quota(s, "key", 3, "id"), "q").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["key"]: r["n"] for r in got} == {"k0": 3, "k1": 3, "k2": 3}


def test_stream_and_table_give_the_same_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, events(12))
    table = spark.read.parquet(path)
    late = events(1, 400)  # moves the watermark past all windows before
    write(spark, path, late)
    s = ops.scan(spark, path, table.schema)
    got = {tuple(r) for r in ops.collect_once(ops.windowed_counts(s, "1 day", "1 hour", "key"), "w").collect()}
    whole = {tuple(r) for r in ops.windowed_counts(spark.read.parquet(path), "1 day", "1 hour", "key").collect()}
    assert got <= whole and len(whole - got) == 1
