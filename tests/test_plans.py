import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.operators import outliers as M
from worksight.plans import exact_quantiles, global_rank, materialize, scratch_dir
from worksight.plans.materialize import spread
from worksight.plans.skew import lookup_join


@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_with_ties_is_a_permutation(spark, partitions):
    df = spark.range(5000).selectExpr("concat('P', id) as k", "(id * id) % 7 as s").repartition(partitions)
    got = global_rank(df, [F.col("s").desc(), F.col("k").asc()], "rank", partitions=5).collect()
    want = sorted(((r.k, r.s) for r in got), key=lambda x: (-x[1], x[0]))
    assert [(r.k, r.s) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))


@pytest.mark.parametrize("bins", [16, 4096])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_quantiles_equal_numpy(spark, bins, q):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.expovariate(1) ** 8, float(rng.randint(0, 3)), 5.0, None) for _ in range(999)]
    rows += [(None, 1e12, 1.0, None, None)]
    columns = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in columns))
    got = exact_quantiles(df, columns, q, bins=bins)
    for i, x in enumerate(columns[:4]):
        want = np.quantile([r[i] for r in rows if r[i] is not None], q)
        assert got[x] == pytest.approx(float(want), rel=1e-12, abs=1e-15)
    assert got["e"] is None


def test_quantile_is_a_value_of_the_column_or_between_two(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    assert exact_quantiles(df, ["v"], 0.5)["v"] == ordered[499] + (ordered[500] - ordered[499]) * (0.5 * 999 - 499)
    far = spark.createDataFrame([(-1.7e308,), (0.0,), (5e-324,), (1.7e308,)], "v double")
    assert exact_quantiles(far, ["v"], 0.0)["v"] == -1.7e308 and exact_quantiles(far, ["v"], 1 / 3)["v"] == 0.0


def test_materialize_keeps_rows_and_types(spark):
    df = spark.sql("select 1 as a, array('x') as b, cast(null as double) as c, timestamp'2020-01-01 00:00:00' as d")
    stored = materialize(df, "test")
    assert stored.schema.simpleString() == df.schema.simpleString() and stored.collect() == df.collect()
    assert any(scratch_dir(spark) in f for f in stored.inputFiles())
    assert spread(spark.range(10).coalesce(1), 10).rdd.getNumPartitions() == 1
    assert spread(spark.range(10**5).coalesce(1), 10_000).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("most", [100_000, 1])
def test_crowded_keys_and_lookup(spark, most):
    from worksight.plans import skew
    facts = spark.range(1000).selectExpr("case when id % 3 = 0 then 0 when id % 3 = 1 then 1 else id end as k", "id")
    found = skew.crowded_keys(facts, ["k"], 50, most)
    assert sorted(map(tuple, found.collect())) == [(0, 334), (1, 333)]
    assert skew.crowded_keys(facts, ["k"], 400) is None
    table = spark.range(1000).selectExpr("id as k", "id * 2 as v")
    got = skew.lookup_join(facts, table, "k", "id", limit=50)
    want = facts.join(table, "k")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- isolation forest -------------------------------------------------------------

def portfolio(spark, n=2000, partitions=4):
    rng = np.random.default_rng(0)
    x = rng.normal(50, 10, size=(n, 4))
    x[:10] += 400                                          # planted
    rows = [(f"P{i}", *map(float, r)) for i, r in enumerate(x)]
    names = list(M.OUTLIER_FEATURES)
    return spark.createDataFrame(rows, "project_id string, " + ", ".join(f"{c} double" for c in names)).repartition(
        partitions)


def test_forest_finds_planted_rows_whatever_the_partitioning(spark):
    first, fitted = M.ml_outliers(portfolio(spark), trees=60)
    rows = first.collect()
    assert fitted and len(rows) == 2000 and sum(r.ml_anomaly for r in rows) == 100
    ranked = sorted(rows, key=lambda r: -r.ml_anomaly_score)
    assert {r.project_id for r in ranked[:10]} == {f"P{i}" for i in range(10)}
    assert ranked[0].ml_anomaly_score == 100.0 and ranked[-1].ml_anomaly_score == 0.0
    again = M.ml_outliers(portfolio(spark, partitions=1), trees=60)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_sample_sizes(spark):
    for n, partitions in ((30, 2), (3000, 3), (90_000, 4)):
        df = spark.range(n).selectExpr("concat('P', id) as project_id").repartition(partitions)
        counts = M.draw_samples(df, n, trees=20, subsample=256, seed=1).groupBy("tree").agg(
            F.count("*").alias("n"), F.countDistinct("project_id").alias("d")).collect()
        assert len(counts) == 20 and all(r.n == r.d == min(n, 256) for r in counts)


def test_gate_and_constant_scores(spark):
    names = list(M.OUTLIER_FEATURES)
    few = portfolio(spark).limit(19)
    got, fitted = M.ml_outliers(few)
    assert not fitted and not any(r.ml_anomaly or r.ml_signal_available for r in got.collect())
    one = portfolio(spark, 100).select("project_id", names[0], *[F.lit(None).cast("double").alias(x) for x in names[1:]])
    assert not M.ml_outliers(one)[1]
    same = spark.range(50).select(F.col("id").cast("string").alias("project_id"), *[F.lit(1.0).alias(x) for x in names])
    rows = M.ml_outliers(same, trees=5)[0].collect()
    assert all(r.ml_anomaly_score == 0.0 and not r.ml_anomaly for r in rows)
    assert all(r.ml_top_feature == names[0] and r.ml_top_feature_z == 0.0 for r in rows)


def test_expected_path_and_units():
    from worksight.operators.trees import UNIT, expected_path, path_units, total_units
    assert list(expected_path([0, 1, 2])) == [0.0, 0.0, 1.0]
    assert expected_path([256])[0] == pytest.approx(10.2448, abs=1e-3)
    rows = np.zeros((1, 8), np.int64)
    rows[0, [3, 4, 5]] = 1, 1, 2                     # root and its left child are split
    units = path_units(rows)
    whole = expected_path([4])[0]
    assert [round(u * whole / UNIT, 6) for u in units[0, [3, 4, 5]]] == [1, 2, 3]
    feature, split = np.full((1, 8), -1), np.zeros((1, 8))
    feature[0, [1, 2]], split[0, [1, 2]] = 0, (10.0, 1.0)
    total = total_units(feature, split, units, 2, np.array([[100.0], [10.0], [1.0], [-5.0]]))
    assert list(total) == [units[0, 3], units[0, 5], units[0, 4], units[0, 4]]


def test_grown_trees_follow_their_rule(spark):
    """Every split lies inside the values of its node, halves are right, and only nodes of equal rows or full depth end."""
    import hashlib

    def share(*parts):
        return int(hashlib.md5(" ".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16 ** 13

    rng = np.random.default_rng(2)
    rows = [(f"P{i}", *map(float, rng.integers(0, 6, 2)), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "project_id string, a double, b double, k double").repartition(3)
    depth, trees = 4, 3
    sample = M.draw_samples(df, 120, trees, 50, 7)
    drawn = {}
    for r in sample.collect():
        drawn.setdefault(r.tree, []).append((r.a, r.b, r.k))
    by_hash = [sorted((share(7, "row", t, p), p, x) for p, *x in rows)[:50] for t in range(trees)]     # one slot: a round for each tree
    assert {t: sorted(v) for t, v in drawn.items()} == {t: sorted(tuple(x) for _, _, x in v) for t, v in enumerate(by_hash)}
    leaves, splits = {}, {}

    def walk(tree, node, level, inside):
        bounds = [(i, min(v), max(v)) for i, v in enumerate(zip(*inside)) if max(v) > min(v)]
        if level == depth or not bounds:
            leaves[tree, node] = len(inside)
            return
        f, low, high = bounds[int(share(7, "feature", tree, node) * len(bounds))]
        cut = low + share(7, "split", tree, node) * (high - low)
        cut = cut if cut < high else low
        splits[tree, node] = (f, cut)
        walk(tree, 2 * node, level + 1, [x for x in inside if x[f] <= cut])
        walk(tree, 2 * node + 1, level + 1, [x for x in inside if x[f] > cut])

    for t, inside in drawn.items():
        walk(t, 1, 0, inside)
    grown = M.grow(sample, ["a", "b", "k"], depth, 7).collect()
    got = {}
    for r in grown:
        got[r.tree, r.at] = got.get((r.tree, r.at), 0) + 1
        for s in r.steps:
            assert splits[r.tree, s.node] == (s.feature, s.split)
    assert got == leaves


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_of_a_hot_key(spark, how):
    facts = spark.range(900).selectExpr("id as row", "case when id % 3 = 0 then 0 else id end as k", "id % 2 as j")
    table = facts.where("k % 5 < 4").select("k", "j", F.lit(1).alias("found")).distinct()
    got = lookup_join(facts, table, ["k", "j"], "row", limit=20, how=how)
    assert sorted(got.collect()) == sorted(facts.join(table, ["k", "j"], how).select(*got.columns).collect())
    assert "_salt" in got._jdf.queryExecution().toString()
