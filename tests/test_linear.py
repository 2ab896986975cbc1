"""General linear models, and neighbours and order of rows, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletrail.functions.tails import f_upper, t_two_sided
from tabletrail.operators import linear, models, plots, rows

LEVELS = ("a", "b", "c")


def samples(spark, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for feature in range(25):
        for i in range(rng.integers(1, 40)):
            group = str(rng.choice(["a", "b"] if feature == 3 else ["a", "b", "c", "d"]))
            x = 7.0 if feature == 4 else float(rng.normal())
            y = 1000 + 3 * x + (group == "b") * 2 + rng.normal()
            out.append((feature, group, x, None if i % 13 == 5 else 2 * x if feature == 6 else float(rng.normal()), y))
    return spark.createDataFrame(out, "feature int, g string, x double, z double, y double")


def by_hand(data, feature):
    """Least squares with R's rule: a column that earlier ones explain has no coefficient."""
    use = data[(data.feature == feature) & data.g.isin(LEVELS) & data.z.notna()]
    columns = [np.ones(len(use)), use.g == "b", use.g == "c", use.x, use.z]
    full = np.column_stack([np.asarray(c, dtype=float) for c in columns])
    kept = []
    for j in range(full.shape[1]):
        if np.linalg.matrix_rank(full[:, [*kept, j]], tol=1e-8) > len(kept):
            kept.append(j)
    x, y = full[:, kept], use.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(((y - x @ beta) ** 2).sum())
    sds = np.sqrt(np.diag(np.linalg.inv(x.T @ x)))
    coefficients, stdevs = [None] * 5, [None] * 5
    for j, b, u in zip(kept, beta, sds):
        coefficients[j], stdevs[j] = float(b), float(u)
    residual = len(y) - len(kept)
    s2 = rss / residual if residual > 0 else None
    f = None if len(kept) < 2 or not s2 else (float(((y - y.mean()) ** 2).sum()) - rss) / (len(kept) - 1) / s2
    return coefficients, stdevs, len(kept), residual, s2, f


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7))


def test_linear_models_match_least_squares(spark):
    table = samples(spark)
    design = linear.Design({"g": LEVELS}, ("x", "z"))
    assert design.terms == ["intercept", "gb", "gc", "x", "z"]
    data, seen = table.toPandas(), set()
    for r in linear.fit_linear(table.repartition(5), "feature", "y", design).collect():
        coefficients, stdevs, rank, residual, s2, f = by_hand(data, r.feature)
        assert (r["rank"], r.df_residual) == (rank, residual)
        assert all(map(close, r.coefficients, coefficients)) and all(map(close, r.stdevs, stdevs))
        if residual > 0:
            assert close(r.s2, s2) and close(r.f, f)
        else:
            assert r.s2 is None and r.f is None and r.f_p_value is None
        seen.add(rank)
    assert {4, 5} <= seen


def test_design_without_terms_and_with_one_level(spark):
    table = samples(spark)
    mean = {r.feature: r.m for r in table.groupBy("feature").agg(F.avg("y").alias("m")).collect()}
    for r in linear.fit_linear(table, "feature", "y", linear.Design()).collect():
        assert len(r.coefficients) == 1 and close(r.coefficients[0], mean[r.feature]) and r.f is None
    only_a = linear.fit_linear(table, "feature", "y", linear.Design({"g": ["a"]}, ["x"]))
    counts = {r.feature: r["count"] for r in table.filter("g = 'a'").groupBy("feature").count().collect()}
    assert {r.feature: r.n for r in only_a.collect()} == counts
    assert linear.fit_linear(table.limit(0), "feature", "y", linear.Design({"g": LEVELS}, ["x"])).count() == 0


def test_two_level_design_is_the_two_group_model(spark):
    table = samples(spark)
    design = linear.Design({"g": ("a", "b")})
    general = {r.feature: r for r in linear.coefficient(linear.fit_linear(table, "feature", "y", design), "feature", design, "gb").collect()}
    for r in models.fit_two_groups(table, "feature", "y", "g", ("a", "b")).collect():
        own = general[r.feature]
        assert close(own.log_fc, r.log_fc) and close(own.stdev_unscaled, r.stdev_unscaled) and own.df_residual == r.df_residual
    top = linear.top_table_of(table, "feature", "y", design, "gb").collect()
    plain = models.top_table(table, "feature", "y", "g", ("a", "b")).collect()
    assert [r.feature for r in top] == [r.feature for r in plain] and all(close(a.p_value, b.p_value) for a, b in zip(top, plain))


def test_ordinary_tests(spark):
    table = samples(spark)
    design = linear.Design({"g": LEVELS}, ("x", "z"))
    data = table.toPandas()
    for r in linear.ordinary_tests(linear.fit_linear(table, "feature", "y", design), "feature", design).collect():
        coefficients, stdevs, _, residual, s2, _ = by_hand(data, r.feature)
        j = design.terms.index(r.term)
        if coefficients[j] is not None and s2:
            t = coefficients[j] / (stdevs[j] * math.sqrt(s2))
            assert close(r.t, t) and close(r.p_value, float(t_two_sided(np.array([t]), np.array([residual]))[0]))


def test_f_tail_by_quadrature():
    for df1, df2, f in ((1, 5, 2.0), (3, 40, 0.4), (4, 600, 3.3), (7, 2, 1.0), (2, 9, 30.0)):
        u = np.linspace(0, 1, 2_000_001)[1:-1]
        x = f + u / (1 - u)
        log_density = (df1 / 2) * math.log(df1) + (df2 / 2) * math.log(df2) + (df1 / 2 - 1) * np.log(x) - (df1 + df2) / 2 * np.log(df2 + df1 * x)
        log_density -= math.lgamma(df1 / 2) + math.lgamma(df2 / 2) - math.lgamma((df1 + df2) / 2)
        area = float((np.exp(log_density) / (1 - u) ** 2).sum() * (u[1] - u[0]))
        assert math.isclose(float(f_upper(f, df1, df2)), area, rel_tol=1e-3)
    # F with one numerator degree of freedom is the square of t.
    assert math.isclose(float(f_upper(2.5**2, 1, 12)), float(t_two_sided(2.5, 12)), rel_tol=1e-10)
    assert np.isnan(f_upper(np.nan, 2, 3)) and f_upper(0.0, 2, 3) == 1.0


# --- rows -------------------------------------------------------------------------


def brute_neighbours(x, ids, k):
    apart = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(apart, np.inf)
    return {int(ids[i]): set(ids[np.argsort(apart[i], kind="stable")[:k]].tolist()) for i in range(len(ids))}


def recall(found, want):
    pairs = {(r.vec_id, r.near) for r in found}
    asked = {r.vec_id for r in found}
    return sum(len({n for q, n in pairs if q == i} & want[i]) for i in asked) / sum(len(want[i]) for i in asked)


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 4
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.6
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return x, table


def test_nearest_rows_of_clusters(spark, clusters):
    x, table = clusters
    awkward = table.unionByName(spark.createDataFrame([(9000, None), (9001, [1.0])], table.schema))
    found = rows.nearest_rows(awkward, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert {r.vec_id for r in found} == set(range(0, 1500, 20)) and recall(found, brute_neighbours(x, np.arange(1500), 10)) >= 0.9
    for r in found[:50]:
        assert close(r.distance, float(np.linalg.norm(x[r.vec_id] - x[r.near]))) and r.vec_id != r.near
    # Clusters are apart, so only a part of all pairs is compared.
    index = rows.Buckets.fitted(table, "embedding", 10, 0.97)
    near, far = np.quantile(np.linalg.norm(x[:300, None] - x[None, :300], axis=2)[~np.eye(300, dtype=bool)], [0.03, 0.5])
    assert index.found(near) > 0.9 and index.found(far) < 0.6


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = table.toPandas()
    want = brute_neighbours(np.array(data.embedding.tolist(), dtype=float), data.vec_id.to_numpy(), 10)
    found = rows.nearest_rows(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert len(found) == 10 * len({r.vec_id for r in found}) and recall(found, want) >= 0.9


def test_neighbours_write_no_pairs(spark):
    # All rows share their buckets: half are copies of one vector, ids are texts and one is repeated.
    rng = np.random.default_rng(3)
    x = np.vstack([np.zeros((300, 4)), rng.normal(size=(300, 4)) * 1e-3])
    data = [(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("r599", x[599].tolist()), (None, x[0].tolist())]
    table = spark.createDataFrame(data, "id string, v array<double>")
    found = rows.nearest_rows(table, "id", "v", F.col("id").endswith("9"), index=rows.Buckets(4, 100.0, 1, 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan
    per = {}
    for r in found.collect():
        per.setdefault(r.id, []).append((r.rank, r.distance, r.near))
    assert len(per) == 60 and all(len(v) == 10 for v in per.values())
    for i in range(9, 590, 10):
        far = sorted((float(np.sqrt(np.cumsum((x[i] - v) ** 2)[-1])), name) for name, v in data if name not in (None, f"r{i:03d}"))[:10]
        assert [(d, n) for _, d, n in sorted(per[f"r{i:03d}"])] == far


def test_place_chance_matches_draws():
    rng = np.random.default_rng(0)
    for distance, width in ((0.5, 1.0), (1.0, 1.0), (3.0, 2.0)):
        gap = rng.normal(size=200_000) * distance
        offset = rng.uniform(0, width, 200_000)
        share = np.mean(np.floor(offset / width) == np.floor((offset + gap) / width))
        assert abs(share - rows.Buckets.same_place(width, distance)) < 0.01


def test_row_order_keeps_clusters_together(spark, clusters):
    x, table = clusters
    ordered = rows.row_order(table.repartition(7), "vec_id", "embedding", leaf=64).orderBy("position").collect()
    assert [r.position for r in ordered] == list(range(1, 1501)) and len({r.vec_id for r in ordered}) == 1500
    seats = np.array([r.vec_id for r in ordered])
    steps = np.linalg.norm(x[seats[1:]] - x[seats[:-1]], axis=1)
    shuffled = np.linalg.norm(x[1:] - x[:-1], axis=1)
    assert np.mean(steps) < 0.35 * np.mean(shuffled)
    again = rows.row_order(table.repartition(3), "vec_id", "embedding", leaf=64).orderBy("position").collect()
    assert [r.vec_id for r in again] == [r.vec_id for r in ordered]


def test_row_order_of_equal_and_missing_rows(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)] + [(100, None), (101, [5.0, 5.0])], "i long, v array<double>")
    ordered = rows.row_order(table, "i", "v", leaf=8)
    assert ordered.count() == 102 and ordered.agg(F.count_distinct("position")).first()[0] == 102
    assert rows.row_order(table.limit(0), "i", "v").count() == 0


# --- boxes, wide matrices -------------------------------------------------------------


def test_box_of_a_group_without_values(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", float("nan"))], "g string, v double")
    found = {r.g: (r.n, r.median, r.n_outliers) for r in plots.box_summary(table, "g", "v").collect()}
    assert found == {"a": (2, 2.0, 0), "b": (0, None, 0)}
