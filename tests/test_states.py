import random

from pyspark.sql import functions as F

from beatwire.operators import states as st


def test_merged_moments_equal_the_direct_ones(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-{1 + i % 20:02d}", ("a", "b", None)[i % 3], 1e9 + rng.gauss(0, 1), rng.gauss(5, 2))
            for i in range(3_000)]
    rows += [("2024-01-03", "flat", 1.0, float(i)) for i in range(5)] + [("2024-01-04", "one", 1.0, 2.0)]
    rows += [("2024-01-05", "a", None, 1.0), ("2024-01-05", "a", 1.0, None)]
    df = spark.createDataFrame(rows, "day string, g string, x double, y double")
    parts = [df.where(F.pmod(F.hash("x", "y"), F.lit(4)) == i) for i in range(4)]
    states = parts[0].transform(lambda d: st.moment_states(d, "day", ["g"], "x", "y"))
    for part in parts[1:]:
        states = states.unionByName(st.moment_states(part, "day", ["g"], "x", "y"))
    for first, last in ((None, None), ("2024-01-03", "2024-01-07"), ("2024-01-04", None)):
        got = {r.g: r for r in st.correlation_of(st.merge_moments(states, ["g"], first, last)).collect()}
        ranged = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()
                          & F.col("day").between(first or "0", last or "9"))
        want = ranged.groupBy("g").agg(
            F.count("*").alias("n"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"),
            F.covar_pop("x", "y").alias("c"), F.try_divide(
                F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r")).collect()
        assert set(got) == {r.g for r in want}
        for w in want:
            g = got[w.g]
            assert g.n == w.n and abs(g.mean_y - w.my) < 1e-9
            assert abs(g.m2_x / g.n - w.vx) < 1e-6 and abs(g.c_xy / g.n - w.c) < 1e-6
            if w.g in ("flat", "one"):
                assert g.r is None
            else:
                assert abs(g.r - w.r) < 1e-6


def test_sketches_stay_within_their_error(spark):
    """200,000 distinct sources over 30 days in two batches: within three standard errors."""
    df = spark.range(400_000).select(
        F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 30 + 1).cast("string"), 2, "0")).alias("day"),
        (F.col("id") % 200_000).cast("string").alias("source"), F.lit(1).alias("theft"))
    half = F.col("day") < "2024-01-11"
    states = st.overview_states(df.where(half), "day", ["theft"]).unionByName(
        st.overview_states(df.where(~half), "day", ["theft"]))
    row = st.overview_of(states).first()
    assert (row.n_articles, row.n_labels) == (400_000, 400_000)
    assert abs(row.n_sources - 200_000) < 3 * 200_000 * 1.04 / 2 ** (st.LG_K / 2)
    few = st.overview_of(states, "2024-02-01").first()
    assert tuple(few) == (0, 0, 0)
    some = st.overview_states(df.where("id < 300"), "day", ["theft"])
    assert st.overview_of(some).first().n_sources == 300
