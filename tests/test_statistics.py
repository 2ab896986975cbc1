"""Statistics against brute force, closed forms and an independent library."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabletrail.functions import tails
from tabletrail.operators import matrices, models, plots, summaries
from tabletrail.operators.tests_of_means import adjust_p_values, t_test
from tabletrail.sources.synthetic import expression_matrix, grouped_normals

EXAMPLE = [
    ("S01", "A", "tumor", 11.4667, 1e-300), ("S02", "B", "tumor", 12.1008, 4.2e-8), ("S03", "A", "tumor", 12.1851, 0.031),
    ("S04", "B", "tumor", 12.4264, 0.44), ("S05", "A", "tumor", 11.3357, 0.9), ("S06", "B", "tumor", 12.7891, 0.12),
    ("S07", "A", "normal", 10.2185, 1e-300), ("S08", "B", "normal", 10.3976, 4.2e-8), ("S09", "A", "normal", 10.1366, 0.031),
    ("S10", "B", "normal", 10.7081, 0.44), ("S11", "A", "normal", 10.0286, 0.9), ("S12", "B", "normal", 11.1878, 0.12),
]


@pytest.fixture(scope="module")
def example(spark):
    return spark.createDataFrame(EXAMPLE, "sample_id string, batch string, group string, intensity double, p_value double")


def test_batch_stats_golden(example):
    assert [tuple(r) for r in summaries.summarize_batches(example).collect()] == [
        ("A", "normal", 3, 10.1279, 1e-300), ("B", "normal", 3, 10.7645, 4.2e-8),
        ("A", "tumor", 3, 11.6625, 1e-300), ("B", "tumor", 3, 12.4388, 4.2e-8),
    ]


def test_ranking_golden(example):
    want = "S01 S07 S02 S08 S03 S09 S06 S12 S04 S10 S05 S11".split()
    assert [r["sample_id"] for r in summaries.rank_by_significance(example).collect()] == want
    ranked = summaries.significance_ranks(example).orderBy("rank").collect()
    assert [r["sample_id"] for r in ranked] == want and [r["rank"] for r in ranked] == list(range(1, 13))


def test_t_tail_matches_commons_math(spark):
    jvm = spark._jvm
    for df in (1.0, 2.5, 10.0, 58.0, 1e4):
        dist = jvm.org.apache.commons.math3.distribution.TDistribution(None, df, 1e-15)
        for t in (0.0, 0.01, 0.3, 1.0, 2.0, 7.5, 30.0):
            want = 2 * dist.cumulativeProbability(-t)
            got = float(tails.t_two_sided(np.array([t]), np.array([df]))[0])
            assert got == pytest.approx(want, rel=1e-9, abs=1e-290)


def test_t_tail_closed_forms():
    t = np.array([1e-9, 1e-6, 0.5, 3.0, 1e3, 1e8])
    one = tails.t_two_sided(t, np.full(6, 1.0))
    assert one == pytest.approx(2 / math.pi * np.arctan2(1, t), rel=1e-12)
    two = tails.t_two_sided(t, np.full(6, 2.0))
    assert two == pytest.approx(2 / (2 + t * t + t * np.sqrt(2 + t * t)), rel=1e-12)


def test_t_tail_edges():
    p = tails.t_two_sided(np.array([0.0, np.inf, np.nan, 2.0, 40.0, -1e6]), np.array([5.0, 5.0, 5.0, np.inf, np.inf, 60.0]))
    assert p[0] == 1 and p[1] == 0 and math.isnan(p[2])
    assert p[3] == pytest.approx(math.erfc(2 / math.sqrt(2)))
    assert p[4] == 0 or p[4] < 1e-300
    assert 0 < p[5] < 1e-200


def test_tails_of_a_batch_with_many_degrees_of_freedom():
    # Some values of a batch are over long before others; all together never were.
    t = np.random.default_rng(0).normal(size=64) * 5
    for df in (1e4, 1e5, 4e6, 1e9):
        batch = tails.t_two_sided(t, np.full(64, df))
        assert batch == pytest.approx([float(tails.t_two_sided([x], [df])[0]) for x in t], rel=1e-14)
        assert tails.f_upper(t * t, np.ones(64), np.full(64, df)) == pytest.approx(batch, rel=1e-5)
    assert batch == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in t], rel=1e-6)


def test_polygamma():
    assert float(tails.digamma(np.array([1.0]))[0]) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert float(tails.trigamma(np.array([1.0]))[0]) == pytest.approx(math.pi**2 / 6, abs=1e-13)
    for y in (0.01, 0.7, 3.0, 250.0):
        assert tails.trigamma_inverse(float(tails.trigamma(np.array([y]))[0])) == pytest.approx(y, rel=1e-9)


def _welch(a, b):
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    return (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_t_tests(spark, partitions):
    df = grouped_normals(spark, {"control": 0.0, "treatment": 1.5}, 30).repartition(partitions)
    rows = df.toPandas()
    a, b = (rows[rows.group == g].value for g in ("control", "treatment"))
    pooled = t_test(df, "value", "group", ("control", "treatment")).first()
    sp2 = (a.var(ddof=1) * 29 + b.var(ddof=1) * 29) / 58
    assert pooled["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(sp2 * 2 / 30))
    assert pooled["df"] == 58
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(58.0)
    assert pooled["p_value"] == pytest.approx(2 * dist.cumulativeProbability(-abs(pooled["t"])), rel=1e-8)
    welch = t_test(df, "value", "group", ("control", "treatment"), equal_var=False).first()
    assert (welch["t"], welch["df"]) == pytest.approx(_welch(a, b))


def test_t_test_undefined_is_null(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("y", "a", 2.0), ("z", "a", 1.0), ("z", "a", 1.0), ("z", "b", 1.0)], "k string, g string, v double")
    for equal in (True, False):
        for row in t_test(df, "v", "g", ("a", "b"), ["k"], equal_var=equal).collect():
            assert row["t"] is None and row["p_value"] is None


def test_bh_adjustment(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([np.round(rng.random(300), 2), [0.0, 1.0, 1e-300, 0.05, 0.05], np.full(150, 0.02)])
    frame = pd.DataFrame({"id": range(len(p) + 2), "p": [*p, None, np.nan]})
    got = adjust_p_values(spark.createDataFrame(frame), "p").orderBy("id").toPandas()["adj_p_value"]
    order = np.argsort(-p, kind="stable")
    ranks = len(p) - np.arange(len(p))
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / ranks))
    assert got[: len(p)].to_numpy() == pytest.approx(want, rel=1e-12)
    assert got[len(p):].isna().all()


def test_quantiles_and_box(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 900), "v": np.round(rng.standard_cauchy(900), 2)})
    frame.loc[frame.index[:300], ["g", "v"]] = ["a", 0.5]
    got = plots.box_summary(spark.createDataFrame(frame), "g", "v").toPandas().set_index("g")
    for g, values in frame.groupby("g")["v"]:
        q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = values[(values >= low) & (values <= high)]
        row = got.loc[g]
        assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, median, q3))
        assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
        assert row["n_outliers"] == len(values) - len(inside) and row["n"] == len(values)


def test_quantiles_survive_a_useless_sketch(spark):
    """Brackets that miss the quantile must be noticed and replaced."""
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"g": np.repeat(["a", "b"], 4000), "v": rng.exponential(size=8000).round(3)})
    df = spark.createDataFrame(frame).repartition(7)
    for probabilities in ([0.0, 0.3, 1.0], [0.5]):
        for accuracy in (10_000, 10**9):
            got = plots.quantiles(df, "g", "v", probabilities, accuracy=min(accuracy, 2**31 - 1)).toPandas().set_index("g")
            for g, values in frame.groupby("g")["v"]:
                want = np.quantile(values, probabilities)
                assert [got.loc[g, f"q{i}"] for i in range(len(want))] == pytest.approx(want)


def test_missed_brackets_are_counted_in_full(spark, monkeypatch):
    frame = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 300, "v": np.arange(800.0)})
    df = spark.createDataFrame(frame)
    exact = {r["g"]: r for r in plots.quantiles(df, "g", "v").collect()}
    whole = plots._bracketed

    def blind(rows, brackets, group, n):
        return whole(rows, brackets, group, n).filter("g <> 'b' or _v is null")

    monkeypatch.setattr(plots, "_bracketed", blind)
    assert {r["g"]: r for r in plots.quantiles(df, "g", "v").collect()} == exact
    assert exact["b"]["q1"] == 649.5


def test_zscores_follow_missing_value_rules(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0), ("d", 1.0), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = summaries.group_zscores(df, "g", "v").toPandas()
    z = {g: list(got[got["g"].isna() if g is None else got["g"] == g]["z_score"]) for g in ("a", "b", "c", "d", None)}
    assert sorted(z["a"]) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    assert sorted(z[None]) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    for g in "bcd":
        assert all(pd.isna(v) for v in z[g])
    skipping = summaries.group_zscores(df.unionByName(spark.createDataFrame([("d", 2.0)], df.schema)), "g", "v", skip_missing=True)
    assert skipping.filter("g = 'd' and z_score is not null").count() == 2


def _expected_moderation(wide, labels):
    """Independent re-computation with pandas for a complete matrix."""
    a, b = wide.loc[:, labels == "Control"], wide.loc[:, labels == "Treatment"]
    n1, n2 = a.shape[1], b.shape[1]
    d = n1 + n2 - 2
    s2 = (a.var(axis=1, ddof=1) * (n1 - 1) + b.var(axis=1, ddof=1) * (n2 - 1)) / d
    z = np.log(s2) - float(tails.digamma(np.array([d / 2]))[0]) + math.log(d / 2)
    spread = z.var(ddof=1) - float(tails.trigamma(np.array([d / 2]))[0])
    effect = b.mean(axis=1) - a.mean(axis=1)
    if spread <= 0:
        post, total = s2.mean(), d * len(s2)
    else:
        d0 = 2 * tails.trigamma_inverse(spread)
        s0 = math.exp(z.mean() + float(tails.digamma(np.array([d0 / 2]))[0]) - math.log(d0 / 2))
        post, total = (d0 * s0 + d * s2) / (d0 + d), min(d0 + d, d * len(s2))
    return effect, effect / np.sqrt(post * (1 / n1 + 1 / n2)), total


@pytest.mark.parametrize("varied", [False, True])
def test_top_table(spark, varied):
    groups = ["Control"] * 15 + ["Treatment"] * 15
    long = expression_matrix(spark, 300, groups)
    if varied:
        scale = 1 + F.pmod(F.xxhash64("feature"), F.lit(5)).cast("double")
        long = long.withColumn("value", 8 + (F.col("value") - 8) * scale)
    table = models.top_table(long, "feature", "value", "group", ("Control", "Treatment"))
    rows = table.toPandas()
    cells = long.toPandas()
    wide = cells.pivot(index="feature", columns="sample", values="value")
    labels = cells.drop_duplicates("sample").set_index("sample")["group"].reindex(wide.columns).to_numpy()
    effect, t, total = _expected_moderation(wide, labels)
    rows_by = rows.set_index("feature").loc[wide.index]
    assert rows_by["log_fc"].to_numpy() == pytest.approx(effect.to_numpy())
    assert rows_by["t"].to_numpy() == pytest.approx(t.to_numpy(), rel=1e-9)
    assert rows_by["p_value"].to_numpy() == pytest.approx(tails.t_two_sided(t.to_numpy(), np.full(len(t), total)), rel=1e-8)
    assert rows_by["ave_expr"].to_numpy() == pytest.approx(wide.mean(axis=1).to_numpy())
    assert list(rows["p_value"]) == sorted(rows["p_value"])
    if not varied:
        called = summaries.significance_calls(table).filter("sig = 'Significant'").toPandas()["feature"]
        assert {f"FEATURE_{i:03d}" for i in range(15)} & set(called)


def test_unequal_residual_degrees_of_freedom(spark):
    groups = ["Control"] * 6 + ["Treatment"] * 6
    long = expression_matrix(spark, 40, groups)
    holes = long.withColumn("value", F.when(F.pmod(F.xxhash64("feature", "sample"), F.lit(6)) > 0, F.col("value")))
    fit = models.fit_two_groups(holes, "feature", "value", "group", ("Control", "Treatment"))
    assert fit.select("df_residual").distinct().count() > 1
    tested = models.moderate(fit)
    assert tested.filter("t is null or p_value is null or p_value not between 0 and 1").count() == 0


def test_design_and_unknown_levels(spark):
    df = spark.createDataFrame([("Control",), ("Treatment",), ("other",), (None,)], "group string")
    rows = models.treatment_design(df, "group", ["Control", "Treatment"]).collect()
    assert [(r["intercept"], r["groupTreatment"]) for r in rows] == [(1, 0), (1, 1), (None, None), (None, None)]


def test_distances_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(40, 11))
    df = spark.createDataFrame([([float(v) for v in row],) for row in matrix], "values array<double>").repartition(5)
    for block in (512, 4):
        got = matrices.position_distances(df, "values", 11, block=block).toPandas()
        assert len(got) == 11 * 10 // 2
        for _, r in got.iterrows():
            assert r["distance"] == pytest.approx(np.linalg.norm(matrix[:, int(r["i"])] - matrix[:, int(r["j"])]))


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_noise_and_jitter_ignore_partitioning(spark, partitions):
    one = grouped_normals(spark, {"Control": 0, "Treatment_A": 1, "Treatment_B": 2}, 50)
    moved = one.repartition(partitions)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, moved.collect()))
    assert {r["group_code"] for r in one.collect()} == {"CON", "TRE"}
    levels = (["Control", "Treatment_A", "Treatment_B"], ["CON", "TRE"])
    keyed = one.withColumn("key", F.concat("group", F.col("value").cast("string")))
    points = plots.strip_points(keyed, "key", "group", "group_code", *levels)
    again = plots.strip_points(keyed.repartition(partitions), "key", "group", "group_code", *levels)
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, again.collect()))
    assert points.filter("abs(x_position - round(x_position)) > 0.4").count() == 0


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("f1", 1.0, 2.0), ("f2", 3.0, None)], "feature string, `a b` double, s2 double")
    long = matrices.long_from_wide(wide, "feature")
    assert long.count() == 4
    back = matrices.wide_from_long(long, "feature", "sample", "value", ["a b", "s2"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_shapes_are_checked(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "i int, x double")
    with pytest.raises(TypeError, match="long_from_wide"):
        matrices.long_from_arrays(df, "i", "x")
    assert matrices.complete_matrix(df, "x") is df
    with pytest.raises(TypeError, match="missing cells"):
        matrices.complete_matrix(df.selectExpr("i", "cast(x as int) x"), "x")


def test_three_axis_layout(spark):
    cube = np.arange(24).reshape(2, 3, 4)
    cells = [(int(i), int(j), int(k), int(cube[i, j, k])) for i in range(2) for j in range(3) for k in range(4)]
    axes = [("i", 2), ("j", 3), ("l", 4)]
    df = spark.createDataFrame(cells, "i bigint, j bigint, l bigint, v bigint")
    vector = matrices.vector_from_matrix(df, "v", axes)
    assert [r["v"] for r in vector.orderBy("k").collect()] == cube.ravel(order="F").tolist()
    assert sorted(map(tuple, matrices.matrix_from_vector(vector, "k", "v", axes).collect())) == sorted(cells)


def test_no_global_window_or_python_over_raw_rows(spark):
    """Raw rows may neither meet in one partition nor pass through Python."""
    df = grouped_normals(spark, {"a": 0, "b": 1}, 1000).withColumn("p", F.abs("value"))
    for result in (summaries.group_zscores(df, "group", "value"), summaries.summarize_batches(df.selectExpr("group batch", "group", "value intensity", "p p_value"))):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Python" not in plan and "Window" not in plan
