"""One least-squares model per feature, with any number of factors and covariates.

A design is turned into columns of 0/1 and numbers; per feature their counts, means and
covariances are one partial aggregation, so no feature's rows ever meet in one task and a
feature that holds most rows costs no more than others. The small systems that remain, one
per feature, are solved in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import missing_to_null
from ..functions.tails import f_p_value, t_p_value
from ..plans import staged
from .models import moderate
from .tests_of_means import adjust_p_values

# A column that others explain but for this share of its variance is not estimable.
ALIASED = 1e-10


@dataclass(frozen=True)
class Design:
    """``value ~ factors + covariates`` with an intercept.

    ``factors`` maps a column to its levels, the first of which is the reference. A row
    with another level, or with a missing number, takes no part.
    """

    factors: dict[str, Sequence] = field(default_factory=dict)
    covariates: Sequence[str] = ()

    @property
    def terms(self) -> list[str]:
        levels = [f"{factor}{level}" for factor, known in self.factors.items() for level in list(known)[1:]]
        return ["intercept", *levels, *self.covariates]

    def columns(self) -> list[Column]:
        """One number per term but the intercept, null where the row takes no part."""
        dummies = [
            F.when(F.col(factor).isin(list(known)), (F.col(factor) == F.lit(level)).cast("double"))
            for factor, known in self.factors.items() for level in list(known)[1:]
        ]
        single = [F.when(F.col(f).isin(list(known)), F.lit(0.0)) for f, known in self.factors.items() if len(known) == 1]
        numbers = [missing_to_null(F.col(c).cast("double")) for c in self.covariates]
        return dummies + ([n + s for n in numbers for s in single] if single else numbers)


def _moments(long: DataFrame, feature: str, value: str, design: Design) -> DataFrame:
    """``feature, n, mean_y, var_y, means, cov_y`` and the upper triangle ``cov`` of every feature."""
    columns = design.columns()
    names = [f"_x{i}" for i in range(len(columns))]
    rows = long.select(feature, missing_to_null(F.col(value).cast("double")).alias("_y"), *[c.alias(n) for c, n in zip(columns, names)])
    rows = rows.dropna(subset=["_y", *names])
    aggregates = {"n": F.count(F.lit(1)), "mean_y": F.avg("_y"), "var_y": F.var_pop("_y")}
    aggregates |= {f"_m{i}": F.avg(a) for i, a in enumerate(names)}
    aggregates |= {f"_y{i}": F.covar_pop(a, "_y") for i, a in enumerate(names)}
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggregates |= {f"_c{i}_{j}": F.covar_pop(names[i], names[j]) for i, j in pairs}
    grouped = rows.groupBy(feature).agg(*[c.alias(n) for n, c in aggregates.items()])

    def packed(found: list[str]) -> Column:
        return F.array(*found).cast("array<double>")

    return grouped.select(
        feature, "n", "mean_y", "var_y", packed([f"_m{i}" for i in range(len(names))]).alias("means"),
        packed([f"_y{i}" for i in range(len(names))]).alias("cov_y"), packed([f"_c{i}_{j}" for i, j in pairs]).alias("cov"),
    )


def _estimable(s: np.ndarray) -> np.ndarray:
    """Which columns of each matrix are no combination of those before them: elimination, pivot by pivot."""
    rest, good = s.copy(), np.zeros(s.shape[:2], bool)
    for j in range(s.shape[1]):
        pivot = rest[:, j, j]
        good[:, j] = pivot > ALIASED * s[:, j, j]
        divisor = np.where(good[:, j], pivot, np.inf)
        rest = rest - rest[:, :, j, None] * rest[:, None, j, :] / divisor[:, None, None]
    return good


def _solve(n, mean_y, var_y, means, cov_y, cov) -> dict[str, np.ndarray]:
    """Least squares of a batch of features from their moments."""
    size, k = means.shape
    s = np.empty((size, k, k))
    upper = np.triu_indices(k)
    s[:, upper[0], upper[1]] = cov
    s[:, upper[1], upper[0]] = cov
    s *= n[:, None, None]
    sy = cov_y * n[:, None]
    good = _estimable(s)
    # A column that is not estimable is taken out: its row and column become those of a unit matrix.
    both = good[:, :, None] & good[:, None, :]
    inverse = np.linalg.inv(np.where(both, s, 0.0) + np.eye(k) * ~good[:, :, None]) * both
    slopes = np.einsum("bij,bj->bi", inverse, sy)
    explained = np.einsum("bi,bi->b", slopes, sy)
    rank = 1 + good.sum(1)
    residual = n - rank
    rss = np.maximum(var_y * n - explained, 0.0)
    s2 = np.divide(rss, residual, out=np.full(size, np.nan), where=residual > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where((rank > 1) & (s2 > 0), explained / (rank - 1) / s2, np.nan)
    sds = np.sqrt(np.einsum("bii->bi", inverse))
    first_sd = np.sqrt(1 / n + np.einsum("bi,bij,bj->b", means, inverse, means))
    missing = np.where(good, 0.0, np.nan)
    return {
        "coefficients": np.column_stack([mean_y - np.einsum("bi,bi->b", slopes, means), slopes + missing]),
        "stdevs": np.column_stack([first_sd, sds + missing]), "rank": rank, "df_residual": residual.astype(float), "s2": s2, "f": f,
    }


def fit_linear(long: DataFrame, feature: str, value: str, design: Design) -> DataFrame:
    """``feature, n, ave_expr, rank, coefficients, stdevs, df_residual, s2, f, f_p_value``.

    ``coefficients`` and ``stdevs`` (standard errors over the residual deviation) are in
    the order of ``design.terms``, null where a term is not estimable for the feature,
    i.e. is a combination of earlier ones. ``f`` tests all terms against the intercept alone.
    """
    moments = _moments(long, feature, value, design)
    kind = moments.schema[feature].dataType.simpleString()
    schema = (
        f"`{feature}` {kind}, n bigint, ave_expr double, rank int, coefficients array<double>, stdevs array<double>, "
        "df_residual double, s2 double, f double"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            arrays = [np.array(batch[c].tolist(), dtype=float).reshape(len(batch), -1) for c in ("means", "cov_y", "cov")]
            found = _solve(batch["n"].to_numpy(dtype=float), batch["mean_y"].to_numpy(), batch["var_y"].to_numpy(), *arrays)
            columns = {c: list(v) if v.ndim == 2 else v for c, v in found.items()}
            yield pd.DataFrame({feature: batch[feature], "n": batch["n"], "ave_expr": batch["mean_y"], **columns})

    def present(column: str) -> Column:
        return F.transform(column, lambda x: F.nanvl(x, F.lit(None).cast("double"))).alias(column)

    solved = moments.mapInPandas(run, schema)
    tidy = solved.select(
        feature, "n", "ave_expr", "rank", present("coefficients"), present("stdevs"), "df_residual",
        *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("s2", "f")],
    )
    return tidy.withColumn("f_p_value", f_p_value(F.col("f"), (F.col("rank") - 1).cast("double"), F.col("df_residual")))


def coefficient(fit: DataFrame, feature: str, design: Design, term: str) -> DataFrame:
    """One term of ``fit_linear`` in the form that :func:`moderate` takes; features without it are left out."""
    place = design.terms.index(term)
    picked = fit.select(
        feature, F.get("coefficients", F.lit(place)).alias("log_fc"), "ave_expr", "df_residual", "s2",
        F.get("stdevs", F.lit(place)).alias("stdev_unscaled"),
    )
    return picked.filter("log_fc is not null")


def ordinary_tests(fit: DataFrame, feature: str, design: Design) -> DataFrame:
    """``feature, term, estimate, std_error, t, p_value``: one row per feature and term."""
    terms = F.array(*[F.lit(t) for t in design.terms])
    rows = fit.select(feature, "df_residual", "s2", F.explode(F.arrays_zip(terms.alias("term"), "coefficients", "stdevs")).alias("r"))
    error = F.sqrt("s2") * F.col("r.stdevs")
    tested = rows.select(feature, "df_residual", F.col("r.term").alias("term"), F.col("r.coefficients").alias("estimate"), error.alias("std_error"))
    tested = tested.withColumn("t", F.col("estimate") / F.nullif("std_error", F.lit(0.0)))
    return tested.withColumn("p_value", t_p_value(F.col("t"), F.col("df_residual"))).drop("df_residual")


def top_table_of(long: DataFrame, feature: str, value: str, design: Design, term: str) -> DataFrame:
    """Fit, moderate and adjust one term over all features; most significant first."""
    chosen = staged(coefficient(fit_linear(long, feature, value, design), feature, design, term))
    tested = staged(moderate(chosen))
    return adjust_p_values(tested, "p_value").select(feature, "log_fc", "ave_expr", "t", "p_value", "adj_p_value").orderBy("p_value", feature)
