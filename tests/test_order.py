import math
import random

from pyspark.sql import functions as F

from quarryline.operators import order


def test_running_numbers_of_keys_of_any_size(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, *range(1000)]), i) for i in range(3000)]
    own = spark.createDataFrame(rows, "key string, by int, index int")
    got = order.numbered(own, ["key"], ["by", "index"], 7).select("row.*", F.col("index").alias("number"), F.spark_partition_id().alias("p")).collect()
    want = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r: n for n, r in enumerate(mine)}
    assert {(r.key, r.by, r["index"]): r.number for r in got} == want and len(got) == 3000
    assert order.numbered(own.limit(0), ["key"], ["by"]).count() == 0


def test_a_single_key_is_numbered_by_several_tasks(spark):
    own = spark.range(20_000).select(F.lit("one").alias("key"), (F.col("id") * 7919 % 20_000).alias("by"))
    placed = order.numbered(own, ["key"], ["by"], 8)
    assert placed.where("index <> row.by").count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "RowNumber" not in plan and "row_number" not in plan


def test_values_at_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, round(rng.gauss(0, 9), 1)])) for _ in range(900)] + [("lone", 3.0), ("none", None)]
    got = {r.label: (r.p0, r.p50, r.p95) for r in order.at_shares(spark.createDataFrame(rows, "label string, value double"), {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for label in {k for k, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == label and v is not None)
        want[label] = tuple(own[math.floor(len(own) * p)] for p in (0.0, 0.5, 0.95))
    assert got == want
