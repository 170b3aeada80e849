"""Sinks and set operations on tables."""

import json

from silverloom.sources import records, sinks


def test_json_leaves_nulls_out(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, {"a": "x", "b": None})], "i int, s string, m map<string,string>")
    assert [json.loads(r.json) for r in sinks.as_json(frame).collect()] == [{"i": 1, "m": {"a": "x"}}]
    sinks.write_json(frame, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["i", "m"]


def test_insert_and_upsert(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.insert_new(held, rows, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, sinks.upsert(held, rows, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_observed_count(spark):
    frame, seen = sinks.observed(spark.range(7), "rows")
    frame.collect()
    assert seen.get == {"rows": 7}


def test_jdbc_table_is_read_in_parts(spark):
    """A table of another database (one in memory that comes with Spark), whole and by parts of a column."""
    url = "jdbc:derby:memory:held;create=true"
    spark.range(100).selectExpr("cast(id as int) as id", "cast(id * id as int) as square").write.jdbc(url, "numbers")
    want = [(i, i * i) for i in range(100)]
    for frame, parts in ((records.read_jdbc(spark, url, "numbers"), 1), (records.read_jdbc(spark, url, "numbers", "id", (0, 100), 4), 4)):
        assert sorted(tuple(r) for r in frame.collect()) == want and frame.rdd.getNumPartitions() == parts
