import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkloom.functions.messages import MESSAGES
from talkloom.operators import examples as E, packed
from talkloom.operators.lookup import keep_first
from talkloom.plans import jobs

ROW = "key string, ord struct<input:int,place:struct<file:string,row:bigint>>, text string, at timestamp, more array<struct<role:string,content:string>>"


def rows(spark, count):
    rng = random.Random(3)
    made = [
        (rng.choice([None, "", "hot", "hot", f"k{rng.randrange(count // 2)}"]),
         (rng.randrange(3), None if rng.random() < 0.1 else (rng.choice([None, "a", "é", "zz"]), i)),
         None if i % 7 == 0 else f"text {i}", None, [("user", f"é{i}"), (None, None)][:i % 3])
        for i in range(count)
    ]
    return spark.createDataFrame(made, ROW).withColumn("at", F.timestamp_seconds(F.col("ord.input")))


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_first_rows_are_those_of_a_window(spark, monkeypatch, size):
    df = rows(spark, 600).repartition(3, "text")
    # The order is not unique where the place is null; these rows are told apart.
    df = df.withColumn("ord", F.struct("ord.input", "ord.place", F.xxhash64("text", "more").alias("tie")))
    monkeypatch.setattr(packed, "PACK_BYTES", size)
    got = E.shuffled_first(df, 1, "key")
    assert got.schema.simpleString() == df.schema.simpleString()
    order = E.shuffle_rank(1, F.col("key"))
    assert got.collect() == keep_first(df, "key", "ord").orderBy(order).collect()
    assert E.shuffled_first(df.limit(0), 1, "key").collect() == []


def test_a_pack_holds_a_key_once(monkeypatch):
    table = pa.table({"key": ["hot"] * 999 + ["b"], "ord": [*range(999, 0, -1), 0], "text": ["x"] * 1000, "to": pa.array([4] * 999 + [2], pa.int32())})
    out = pa.Table.from_batches(packed._packer("key", "ord", "to")(table.to_batches()))
    assert out["to"].to_pylist() == [2, 4]
    assert [packed._read(x.as_buffer()).to_pylist() for x in out["keys"].combine_chunks()] == [[{"key": "b", "ord": 0}], [{"key": "hot", "ord": 1}]]


def test_unify_moves_its_rows_once_and_compressed(spark):
    df = spark.createDataFrame(
        [([("user", "q"), ("assistant", f"answer {i % 40}")], "f", i) for i in range(100)], f"messages {MESSAGES}, source_file string, ord int")
    unified = jobs.unify(df)
    plan = unified._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan
    assert sorted(r.ord for r in unified.collect()) == list(range(40))
    assert unified.collect() == jobs.ordered(jobs.unified_rows(df)).collect()
