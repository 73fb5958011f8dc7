import random

from pyspark.sql import functions as F

from scoreloom.operators import sketches


def test_parts_merge_to_the_whole(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(9), rng.lognormvariate(4, 1)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, part int, v double")
    parts = sketches.sketch_parts(df, "v", ["g"], "part").persist()
    assert parts.count() == 18
    for chosen in (range(9), range(4)):
        kept = sketches.merged(parts.where(F.col("part").isin(*chosen)), ["g"])
        found = sketches.sketched_quantiles(kept, ["g"], (0.01, 0.5, 0.99)).collect()
        ranks = {r["g"]: r["rank"] for r in sketches.sketched_rank(kept, ["g"], 60.0).collect()}
        for r in found:
            values = [v for g, p, v in rows if g == r["g"] and p in chosen]
            assert r["n"] == len(values)
            for q, estimate in zip((0.01, 0.5, 0.99), r["quantiles"]):
                assert abs(sum(v <= estimate for v in values) / len(values) - q) <= sketches.RANK_ERROR
            assert abs(sum(v <= 60 for v in values) / len(values) - ranks[r["g"]]) <= sketches.RANK_ERROR
    parts.unpersist()


def test_values_that_do_not_count(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 2.0), ("b", 1, float("nan")), (None, None, 5.0), ("a", 2, 2.0)],
                               "g string, part int, v double")
    got = sketches.sketched_quantiles(sketches.merged(sketches.sketch_parts(df, "v", ["g"], "part"), ["g"]), ["g"], (0.5,))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", 2, [2.0]), (None, 1, [5.0])]
    assert sketches.sketch_parts(df.limit(0), "v", ["g"], "part").collect() == []
