"""Tests, models, adjustment and plot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import linear, matrices, models, plots, sketches, summaries
from ..operators.tests_of_means import adjust_p_values, t_test
from ..plans import lookup, new_scratch
from ..project import Project
from .publishing import UNIT
from .registry import Tables, query

# Embedding positions are features, vectors are samples, the label is the group.
LONG_SQL = """SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings"""

_T_POOLED = """(avg(v) FILTER (WHERE {g} = {a}) - avg(v) FILTER (WHERE {g} = {b})) / sqrt(
    (var_pop(v) FILTER (WHERE {g} = {a}) * count(v) FILTER (WHERE {g} = {a}) + var_pop(v) FILTER (WHERE {g} = {b}) * count(v) FILTER (WHERE {g} = {b}))
    / (count(v) FILTER (WHERE {g} IN ({a}, {b})) - 2)
    * (1.0 / count(v) FILTER (WHERE {g} = {a}) + 1.0 / count(v) FILTER (WHERE {g} = {b})))"""


def long_embeddings(t: Tables) -> DataFrame:
    position = F.posexplode("embedding").alias("feature", "value")
    return t.embeddings.select("vec_id", "label", position).withColumn("value", F.col("value").cast("double"))


# Two groups that cover all vectors.
HALVES_SQL = LONG_SQL.replace("label,", "(label >= 5)::INT AS label,")


def halves(t: Tables) -> DataFrame:
    return long_embeddings(t).withColumn("label", (F.col("label") >= 5).cast("int"))


@query(
    f"""SELECT feature::INT AS feature, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(t, 6) AS t, df FROM (
        SELECT feature, count(v) FILTER (WHERE label = 0)::BIGINT AS n1, count(v) FILTER (WHERE label = 1)::BIGINT AS n2,
          avg(v) FILTER (WHERE label = 0) AS mean1, avg(v) FILTER (WHERE label = 1) AS mean2,
          {_T_POOLED.format(g='label', a=0, b=1)} AS t, (count(v) FILTER (WHERE label IN (0, 1)) - 2)::DOUBLE AS df
        FROM (SELECT *, value AS v FROM ({HALVES_SQL})) GROUP BY feature)"""
)
def ttest_pooled(t: Tables) -> DataFrame:
    tested = t_test(halves(t), "value", "label", (0, 1), ["feature"], p_values=False)
    return tested.withColumns({c: F.round(c, 6) for c in ("mean1", "mean2", "t")})


# Two-sided tail of t with nu degrees of freedom, w = pi / 2 - atan(|t| / sqrt(nu)): a Simpson sum over
# the angle, as far below w as the integrand reaches, over its closed form.
_TAIL = """(least(w, 40 / sqrt(nu)) / 4000 / 3 * list_sum(list_transform(range(0, 4001),
        lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(sin(greatest(w - least(w, 40 / sqrt(nu)) * i / 4000, 0)), nu - 1)))
        / exp(lgamma(0.5) + lgamma(nu / 2) - lgamma((nu + 1) / 2)) * 2)"""


@query(
    f"""SELECT l_returnflag, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(t, 6) AS t, round(nu, 4) AS df, round(CASE WHEN t IS NOT NULL THEN {_TAIL} END, 9) AS p_value
    FROM (SELECT *, pi() / 2 - atan(abs(t) / sqrt(nu)) AS w FROM (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
        pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS nu
    FROM (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS n1, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS n2,
        avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS m1, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS m2,
        var_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS v1, var_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS v2
      FROM lineitem GROUP BY l_returnflag)))"""
)
def ttest_welch(t: Tables) -> DataFrame:
    tested = t_test(t.lineitem, "l_extendedprice", "l_linestatus", ("F", "O"), ["l_returnflag"], equal_var=False)
    return tested.withColumns({"mean1": F.round("mean1", 6), "mean2": F.round("mean2", 6), "t": F.round("t", 6), "df": F.round("df", 4), "p_value": F.round("p_value", 9)})


# For a whole number of degrees of freedom the t distribution is a finite sum in
# the angle atan(t / sqrt(df)) (Abramowitz and Stegun 26.7.3 and 26.7.4).
_T_TAIL_SUM = """CASE WHEN df % 2 = 0 THEN 1 - sin(a) * list_sum(list_transform(range(0, (df / 2)::BIGINT),
        lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(cos(a), 2 * k)))
    WHEN df = 1 THEN 1 - 2 * a / pi()
    ELSE 1 - 2 / pi() * (a + sin(a) * list_sum(list_transform(range(0, ((df - 1) / 2)::BIGINT),
        lambda k: exp(lgamma(0.5) + lgamma(k + 1.0) - lgamma(k + 1.5)) / 2 * pow(cos(a), 2 * k + 1)))) END"""


@query(
    f"""SELECT l_partkey, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(t, 6) AS t, CASE WHEN t IS NOT NULL OR error > 0 THEN df::DOUBLE END AS df,
        round(CASE WHEN t IS NOT NULL THEN {_T_TAIL_SUM} END, 6) AS p_value
    FROM (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM (SELECT *, CASE WHEN error > 0 THEN (m1 - m2) / error END AS t FROM (
      SELECT *, CASE WHEN n1 > 0 AND n2 > 0 AND df > 0 THEN sqrt((v1 * n1 + v2 * n2) / df * (1.0 / n1 + 1.0 / n2)) END AS error FROM (
        SELECT l_partkey, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS n1, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS n2,
          (count(*) - 2)::BIGINT AS df, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS m1, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS m2,
          coalesce(var_pop(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0) AS v1, coalesce(var_pop(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0) AS v2
        FROM lineitem GROUP BY l_partkey))))"""
)
def ttest_p_values(t: Tables) -> DataFrame:
    tested = t_test(t.lineitem, "l_extendedprice", "l_linestatus", ("F", "O"), ["l_partkey"])
    return tested.withColumns({c: F.round(c, 6) for c in ("mean1", "mean2", "t", "p_value")})


@query(
    f"""SELECT feature::INT AS feature, round(avg(v) FILTER (WHERE label = 1) - avg(v) FILTER (WHERE label = 0), 6) AS log_fc,
        round(avg(v) FILTER (WHERE label IN (0, 1)), 6) AS ave_expr, (count(v) FILTER (WHERE label IN (0, 1)) - 2)::DOUBLE AS df_residual,
        round((var_pop(v) FILTER (WHERE label = 0) * count(v) FILTER (WHERE label = 0) + var_pop(v) FILTER (WHERE label = 1) * count(v) FILTER (WHERE label = 1))
          / (count(v) FILTER (WHERE label IN (0, 1)) - 2), 9) AS s2,
        round(sqrt(1.0 / count(v) FILTER (WHERE label = 0) + 1.0 / count(v) FILTER (WHERE label = 1)), 9) AS stdev_unscaled
    FROM (SELECT *, value AS v FROM ({HALVES_SQL})) GROUP BY feature"""
)
def linear_model_two_group(t: Tables) -> DataFrame:
    fit = models.fit_two_groups(halves(t), "feature", "value", "label", (0, 1))
    return fit.withColumns(
        {"log_fc": F.round("log_fc", 6), "ave_expr": F.round("ave_expr", 6), "s2": F.round("s2", 9), "stdev_unscaled": F.round("stdev_unscaled", 9)}
    )


def _polygamma_sql(x: str, terms: str, series: str) -> str:
    """Recurrence up to x + 12, then the asymptotic series in y."""
    shifted = f"list_sum(list_transform(range(0, 12), lambda i: {terms.format(x=f'({x} + i)')}))"
    return f"({shifted} + {series.format(y=f'({x} + 12)')})"


_DIGAMMA = ("-1.0 / {x}", "(ln({y}) - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)))")
_TRIGAMMA = ("1.0 / pow({x}, 2)", "(1 / {y} + 0.5 / pow({y}, 2) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)))")
_MIDDLE = "pow(10, (lo + hi) / 2)"

# Every feature has the same residual degrees of freedom here. Features are scaled
# unevenly, so that their variances differ by more than chance and the prior, found by
# bisection, is a finite one.
_SCALED_SQL = f"SELECT feature, label, value * (1 + feature % 5) AS value FROM ({HALVES_SQL})"
_TOP_TABLE = f"""WITH RECURSIVE fit AS (SELECT feature, m1 - m0 AS log_fc, (n0 * m0 + n1 * m1) / (n0 + n1) AS ave_expr, (n0 + n1 - 2)::DOUBLE AS d,
        (v0 * n0 + v1 * n1) / (n0 + n1 - 2) AS s2, sqrt(1.0 / n0 + 1.0 / n1) AS u
      FROM (SELECT feature, avg(value) FILTER (WHERE label = 0) AS m0, avg(value) FILTER (WHERE label = 1) AS m1,
          count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1,
          var_pop(value) FILTER (WHERE label = 0) AS v0, var_pop(value) FILTER (WHERE label = 1) AS v1 FROM ({_SCALED_SQL}) GROUP BY feature)),
    spread AS (SELECT avg(e) AS mean_e, var_samp(e) - avg({_polygamma_sql('(d / 2)', *_TRIGAMMA)}) AS x, sum(d) AS limit_d, avg(s2) AS mean_s2
      FROM (SELECT *, ln(s2) - {_polygamma_sql('(d / 2)', *_DIGAMMA)} + ln(d / 2) AS e FROM fit)),
    root(step, lo, hi) AS (SELECT 0, -18.0::DOUBLE, 18.0::DOUBLE UNION ALL
      SELECT step + 1, CASE WHEN {_polygamma_sql(_MIDDLE, *_TRIGAMMA)} > x THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN {_polygamma_sql(_MIDDLE, *_TRIGAMMA)} > x THEN hi ELSE (lo + hi) / 2 END FROM root, spread WHERE step < 90),
    prior AS (SELECT CASE WHEN x > 0 THEN 2 * {_MIDDLE} END AS d0, limit_d,
        CASE WHEN x > 0 THEN exp(mean_e + {_polygamma_sql(_MIDDLE, *_DIGAMMA)} - ln({_MIDDLE})) ELSE mean_s2 END AS s0 FROM root, spread WHERE step = 90),
    tested AS (SELECT feature, log_fc, ave_expr, log_fc / (u * sqrt(CASE WHEN d0 IS NULL THEN s0 ELSE (d0 * s0 + d * s2) / (d0 + d) END)) AS t,
        CASE WHEN d0 IS NULL THEN limit_d ELSE least(d + d0, limit_d) END AS nu FROM fit, prior),
    angles AS (SELECT *, pi() / 2 - atan(abs(t) / sqrt(nu)) AS w FROM tested),
    tails AS (SELECT *, {_TAIL} AS p FROM angles),
    ranked AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS raw FROM tails)
    SELECT feature::INT AS feature, round(log_fc, 6) AS log_fc, round(ave_expr, 6) AS ave_expr, round(t, 6) AS t, round(p, 6) AS p_value,
      round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 6) AS adj_p_value FROM ranked"""


@query(_TOP_TABLE)
def toptable_moderated(t: Tables) -> DataFrame:
    scaled = halves(t).withColumn("value", F.col("value") * (1 + F.col("feature") % 5))
    table = models.top_table(scaled, "feature", "value", "label", (0, 1))
    return table.withColumns({c: F.round(c, 6) for c in ("log_fc", "ave_expr", "t", "p_value", "adj_p_value")})


DESIGN = linear.Design({"l_returnflag": ("A", "N", "R")}, ("l_quantity", "l_discount"))
_TERMS = ["CASE l_returnflag WHEN 'N' THEN 1.0 ELSE 0 END::DOUBLE", "CASE l_returnflag WHEN 'R' THEN 1.0 ELSE 0 END::DOUBLE", "l_quantity::DOUBLE", "l_discount::DOUBLE"]


def _swept(terms: list[str], by: str, value: str, table: str, where: str) -> str:
    """SQL of a least-squares fit per group: sweep the matrix of centred products, pivot by pivot.

    After the sweep of every term, column ``c<i>_y`` is its coefficient, ``c<i>_<i>`` the
    negative of its entry of the inverse, and ``cy_y`` the residual sum of squares.
    """
    k = len(terms)
    names = [*map(str, range(k)), "y"]
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    columns = {n: f"x{n}" for n in names}

    def cell(a: str, b: str) -> str:
        return f"c{a}_{b}" if (a, b) in cells else f"c{b}_{a}"

    listed = ", ".join([*(f"{t} AS x{i}" for i, t in enumerate(terms)), f"{value} AS xy"])
    sums = ", ".join(f"covar_pop({columns[a]}, {columns[b]}) * count(*) AS c{a}_{b}" for a, b in cells)
    means = ", ".join(f"avg({columns[n]}) AS m{n}" for n in names)
    start = ", ".join(f"c{i}_{i} AS v{i}" for i in range(k))
    sql = f"""r AS (SELECT {by}, {listed} FROM {table} WHERE {where}),
    s AS (SELECT *, {start}, cy_y AS total FROM (SELECT {by}, count(*)::BIGINT AS n, {means}, {sums} FROM r GROUP BY {by}))"""
    last = "s"
    for i in map(str, range(k)):
        updates = []
        for a, b in cells:
            if a == b == i:
                new = f"-1 / c{i}_{i}"
            elif i in (a, b):
                new = f"c{a}_{b} / c{i}_{i}"
            else:
                new = f"c{a}_{b} - {cell(a, i)} * {cell(i, b)} / c{i}_{i}"
            updates.append(f"CASE WHEN good THEN {new} ELSE c{a}_{b} END AS c{a}_{b}")
        kept = ", ".join([by, "n", *(f"m{n}" for n in names), *(f"v{j}" for j in range(k)), *(f"g{j}" for j in range(int(i))), f"good AS g{i}", "total"])
        sql += f""", t{i} AS (SELECT {kept}, {", ".join(updates)} FROM (SELECT *, c{i}_{i} > 1e-10 * v{i} AS good FROM {last}))"""
        last = f"t{i}"
    return sql


_LINEAR = _swept(_TERMS, "l_suppkey", "l_extendedprice", "lineitem", "l_returnflag IN ('A', 'N', 'R')")
_RANK = "(1 + " + " + ".join(f"g{i}::INT" for i in range(4)) + ")"
_COEFFICIENTS = ", ".join(f"CASE WHEN g{i} THEN c{i}_y END" for i in range(4))
_INTERCEPT = "my - (" + " + ".join(f"CASE WHEN g{i} THEN c{i}_y * m{i} ELSE 0 END" for i in range(4)) + ")"


# With four terms the tail of F has a closed form: x^a (1 + a (1 - x)), where a is half the residual df.
@query(
    f"""WITH {_LINEAR}, f AS (SELECT *, {_RANK} AS rank, (n - {_RANK})::DOUBLE AS d FROM t3),
    z AS (SELECT *, cy_y / d AS s2, (total - cy_y) / (rank - 1) / (cy_y / d) AS f, unnest(['intercept', 'l_returnflagN', 'l_returnflagR', 'l_quantity', 'l_discount']) AS term,
        unnest([{_INTERCEPT}, {_COEFFICIENTS}]) AS b, unnest([NULL, {", ".join(f"CASE WHEN g{i} THEN sqrt(-c{i}_{i}) END" for i in range(4))}]) AS u FROM f)
    SELECT l_suppkey, term, n, rank::INT AS rank, round(b, 3) AS estimate, CASE WHEN term <> 'intercept' THEN round(u, 9) END AS stdev,
        round(s2, 1) AS s2, round(f, 6) AS f, round(pow(d / (d + 4 * f), d / 2) * (1 + d / 2 * (1 - d / (d + 4 * f))), 6) AS f_p_value FROM z"""
)
def linear_model_design(t: Tables) -> DataFrame:
    """Price of each supplier's items by return flag, quantity and discount."""
    fit = linear.fit_linear(t.lineitem, "l_suppkey", "l_extendedprice", DESIGN)
    terms = F.array(*[F.lit(term) for term in DESIGN.terms])
    rows = fit.select("*", F.explode(F.arrays_zip(terms.alias("term"), "coefficients", "stdevs")).alias("c"))
    return rows.select(
        "l_suppkey", "c.term", "n", "rank", F.round("c.coefficients", 3).alias("estimate"), F.when(F.col("c.term") != "intercept", F.round("c.stdevs", 9)).alias("stdev"),
        F.round("s2", 1).alias("s2"), F.round("f", 6).alias("f"), F.round("f_p_value", 6).alias("f_p_value"),
    )


@query(
    """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 1.0::DOUBLE END AS intercept,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN (c_mktsegment = 'MACHINERY')::INT::DOUBLE END AS "c_mktsegmentMACHINERY",
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN (c_mktsegment = 'FURNITURE')::INT::DOUBLE END AS "c_mktsegmentFURNITURE"
    FROM customer"""
)
def treatment_design(t: Tables) -> DataFrame:
    return models.treatment_design(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"])


_BH = """WITH d AS (SELECT {p} AS p, count(*) AS n FROM {table} GROUP BY 1),
    r AS (SELECT p, sum(n) OVER (ORDER BY p) AS rank, (SELECT count(*) FROM {table}) AS m FROM d),
    a AS (SELECT p, least(1.0, min(p * m / rank) OVER (ORDER BY p DESC)) AS adj FROM r)
    SELECT {columns}, round(adj, 9) AS adj_p_value FROM {table} JOIN a ON a.p = {p}"""


@query(_BH.format(p="l_discount", table="lineitem", columns="l_orderkey, l_linenumber, l_discount"))
def bh_adjust(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount")
    return adjust_p_values(rows, "l_discount").withColumn("adj_p_value", F.round("adj_p_value", 9))


@query(_BH.format(p="(o_totalprice / 1000000)", table="orders", columns="o_orderkey"))
def bh_adjust_continuous(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("p"))
    return adjust_p_values(rows, "p").select("o_orderkey", F.round("adj_p_value", 9).alias("adj_p_value"))


@query(
    """WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b,
        quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem GROUP BY 1),
    w AS (SELECT l.l_returnflag, l_extendedprice AS v, n, a, b, c, l_extendedprice BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside
        FROM lineitem l JOIN q ON q.l_returnflag = l.l_returnflag)
    SELECT l_returnflag, n::BIGINT AS n, round(a, 6) AS q1, round(b, 6) AS median, round(c, 6) AS q3, min(v) FILTER (WHERE inside) AS whisker_low,
        max(v) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside)::BIGINT AS n_outliers
    FROM w GROUP BY l_returnflag, n, a, b, c"""
)
def box_summary(t: Tables) -> DataFrame:
    summary = plots.box_summary(t.lineitem, "l_returnflag", "l_extendedprice")
    return summary.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    """SELECT l_returnflag, count(*)::BIGINT AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, unnest(['q1', 'median', 'q3']) AS quantile,
        true AS within FROM lineitem GROUP BY l_returnflag"""
)
def box_sketches(t: Tables) -> DataFrame:
    """Boxes of prices from sketches of three published runs, and whether each quantile's true rank is within the bound."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    runs = F.concat(F.lit("prices-"), (F.col("l_linenumber") % 3).cast("string"))
    states = sketches.quantile_states(t.lineitem.withColumn("run", runs), ["run", "l_returnflag"], "l_extendedprice")
    project.save_shared_many(states, "run", inputs=[], producer=UNIT)
    kept = summaries.stacked([project.load_shared(f"prices-{i}") for i in range(3)])
    boxes = sketches.estimated_boxes(kept, ["l_returnflag"])
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("quantile"), F.lit(q).alias("p"), F.col(c).alias("estimate")) for c, q in zip(("q1", "median", "q3"), plots.QUARTILES)]))
    quantiles = boxes.select("l_returnflag", "n", "low", "high", asked.alias("a")).select("l_returnflag", "n", "low", "high", "a.*")
    below = lookup(t.lineitem.select("l_returnflag", "l_extendedprice"), boxes.select("l_returnflag", "q1", "median", "q3"), ["l_returnflag"]).groupBy("l_returnflag")
    counts = below.agg(*[F.count_if(F.col("l_extendedprice") <= F.col(c)).alias(f"n_{c}") for c in ("q1", "median", "q3")])
    rank = F.when(F.col("quantile") == "q1", F.col("n_q1")).when(F.col("quantile") == "median", F.col("n_median")).otherwise(F.col("n_q3")) / F.col("n")
    # A value that several rows share has a range of ranks; its last one is compared.
    within = F.abs(rank - F.col("p")) <= F.lit(sketches.rank_error()) + 2 / F.col("n")
    return quantiles.join(counts, "l_returnflag").select("l_returnflag", "n", "low", "high", "quantile", within.alias("within"))


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice,
        round(list_position(['A', 'N', 'R'], l_returnflag) - 1 + (list_position(['F', 'O'], l_linestatus) - 1 - 0.5) * 0.4
          + (('0x' || substr(sha256(l_orderkey || '-' || l_linenumber || '|0'), 1, 8))::BIGINT / 4294967296.0 * 2 - 1) * 0.1, 6) AS x_position
    FROM lineitem"""
)
def strip_points(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_key")
    )
    points = plots.strip_points(rows, "_key", "l_returnflag", "l_linestatus", ["A", "N", "R"], ["F", "O"])
    return points.drop("_key").withColumn("x_position", F.round("x_position", 6))


@query(
    f"""SELECT feature::INT AS feature, vec_id, label, round(value, 6) AS value,
        round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS z,
        CASE label WHEN 0 THEN '#4e79a7' WHEN 1 THEN '#f28e2b' WHEN 2 THEN '#e15759' END AS color
    FROM ({LONG_SQL}) WINDOW w AS (PARTITION BY feature)"""
)
def heatmap_cells(t: Tables) -> DataFrame:
    cells = long_embeddings(t).withColumn("_group", F.col("label").cast("string"))
    palette = {"0": "#4e79a7", "1": "#f28e2b", "2": "#e15759"}
    return plots.heatmap_cells(cells, "feature", "value", "_group", palette).select(
        "feature", "vec_id", "label", F.round("value", 6).alias("value"), F.round("z", 6).alias("z"), "color"
    )
