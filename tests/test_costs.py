import random

from pyspark.sql import functions as F

from taleweft.operators.conversation import cost, cost_text


def test_costs_round_by_their_exact_value(spark):
    """As C's printf does: 0.00705 is below the half of its last place as a double, and 0.03125 is an exact tie."""
    rng = random.Random(1)
    pairs = [(47, 0), (77, 0), (0, 0), (4, 1)] + [(rng.randint(0, 20_000), rng.randint(0, 20_000)) for _ in range(20_000)]
    found = spark.createDataFrame(pairs, "p long, c long").withColumn("x", cost(F.col("c"), F.col("p")))
    other = spark.createDataFrame([(x,) for x in (0.00705, 0.01155, 0.03125, 0.00005, 0.00015, 1234567.00005, 1e-9, None)], "x double")
    for r in found.select("x").unionByName(other).select("x", cost_text(F.col("x")).alias("t")).collect():
        assert r["t"] == (None if r["x"] is None else "$%.4f" % r["x"]), r
