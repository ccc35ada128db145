"""Regimes of series: Gaussian clusters of stacked rows, with a price for each change of cluster along a series.

A round takes the best path of clusters through each series for the present clusters (a dynamic programme, series by
series), sums what the paths say of each cluster as Spark aggregates, and takes the clusters that fit these sums best. Both halves lower

    sum over rows of -log N(x; mean, cov) + penalty * changes + prior / 2 * sum over clusters of (trace of cov^-1 + log det cov)

so it never rises. A series has a row a day; series spread. What comes to the driver is a cluster's mean and covariance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.sources.tables import materialize

#: Rows, the first by a hash, among which the first clusters are looked for.
SAMPLE = 1000


class Clusters(NamedTuple):
    """Parameters; ``objective``: after each round."""

    means: np.ndarray
    covs: np.ndarray
    penalty: float
    objective: tuple[float, ...] = ()

    def costs(self, x: np.ndarray) -> np.ndarray:
        """-log density (without its constant) of each row in each cluster."""
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covs, strict=True)):
            chol = np.linalg.cholesky(c)
            z = np.linalg.solve(chol, (x - m).T)
            out[:, k] = 0.5 * (z * z).sum(axis=0) + np.log(np.diag(chol)).sum()
        return out


def forward(costs: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The least cost of a path that ends in each cluster at each row, and the cluster before."""
    n, k = costs.shape
    total, came = costs.copy(), np.zeros((n, k), np.int64)
    for t in range(1, n):
        best = int(total[t - 1].argmin())
        change = total[t - 1][best] + penalty
        stay = total[t - 1] <= change
        came[t] = np.where(stay, np.arange(k), best)
        total[t] += np.where(stay, total[t - 1], change)
    return total, came


def best_path(costs: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The path of clusters with the least sum of costs and changes, and that sum."""
    if not len(costs):
        return np.zeros(0, np.int64), 0.0
    total, came = forward(costs, penalty)
    path = np.empty(len(costs), np.int64)
    path[-1] = total[-1].argmin()
    for t in range(len(costs) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path, float(total[-1].min())


def stacked(df: DataFrame, columns: list[str], window: int, by: str = "symbol", at: str = "date") -> DataFrame:
    """by, at, x: the columns of the last ``window`` rows, oldest first; null and infinite values count as 0. Rows before the first whole window are left out."""
    clean = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c).cast("double")) for c in columns]
    frame = Window.partitionBy(by).orderBy(at).rowsBetween(-(window - 1), 0)
    out = df.select(by, at, F.array(*clean).alias("_x")).withColumn("x", F.collect_list("_x").over(frame)).where(F.size("x") == window)
    return out.select(by, at, F.flatten("x").alias("x"))


def _first(rows: DataFrame, k: int, by: str, at: str, scale: np.ndarray) -> np.ndarray:
    """k rows of a bounded sample, each as far as can be from those before it."""
    sample = np.array([r["x"] for r in rows.orderBy(F.xxhash64(by, at), by, at).limit(SAMPLE).collect()])
    if not len(sample):
        raise ValueError("no rows to fit")
    chosen = [int((((sample - sample.mean(axis=0)) / scale) ** 2).sum(axis=1).argmin())]
    near = (((sample - sample[chosen[0]]) / scale) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, (((sample - sample[chosen[-1]]) / scale) ** 2).sum(axis=1))
    return sample[chosen]


def fit(rows: DataFrame, k: int, penalty: float, prior: float = 1.0, rounds: int = 30, tolerance: float = 1e-6, by: str = "symbol", at: str = "date") -> Clusters:
    """Clusters from (by, at, x) of ``stacked``: give it the training rows alone. Ends when a round gains less than ``tolerance`` of the objective."""
    rows = materialize(rows.select(by, at, "x"), "regime-rows")
    dim = rows.select(F.size("x").alias("n")).first()
    if dim is None:
        raise ValueError("no rows to fit")
    dim = dim["n"]
    spread = rows.agg(*[F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(dim)]).first()
    scale = np.array([s if s > 1e-12 else 1.0 for s in spread])
    now = Clusters(_first(rows, k, by, at, scale), np.array([np.diag(scale**2)] * k), penalty)
    history: list[float] = []
    for _ in range(rounds):
        sums, cost = _sums(rows, now, by, at)
        history.append(cost + 0.5 * prior * sum(np.trace(np.linalg.inv(c)) + np.linalg.slogdet(c)[1] for c in now.covs))
        if len(history) > 1 and history[-2] - history[-1] <= tolerance * max(1.0, abs(history[-1])):
            break
        means, covs = now.means.copy(), np.array([np.eye(dim)] * k)
        for j, (n, s, outer) in sums.items():
            means[j] = s / n
            scatter = outer - n * np.outer(means[j], means[j])
            covs[j] = ((scatter + scatter.T) / 2 + prior * np.eye(dim)) / (n + prior)
        now = Clusters(means, covs, penalty)
    return now._replace(objective=tuple(history))


def _sums(rows: DataFrame, now: Clusters, by: str, at: str) -> tuple[dict[int, tuple[float, np.ndarray, np.ndarray]], float]:
    """Of each cluster: rows, sum and sum of outer products along the best paths; and what all paths cost."""
    dim = now.means.shape[1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(at)["x"].tolist())
        path, cost = best_path(now.costs(x), now.penalty)
        out = [(-1, 0, cost)]
        for j in np.unique(path).tolist():
            own = x[path == j]
            values = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            out += [(j, i, float(v)) for i, v in enumerate(values)]
        return pd.DataFrame(out, columns=["cluster", "i", "v"])

    cells = rows.groupBy(by).applyInPandas(run, "cluster long, i long, v double").groupBy("cluster", "i").agg(F.sum("v").alias("v")).collect()  # k * (1 + dim + dim**2)
    found: dict[int, np.ndarray] = {}
    cost = 0.0
    for c in cells:
        if c["cluster"] < 0:
            cost = c["v"]
        else:
            found.setdefault(c["cluster"], np.zeros(1 + dim + dim * dim))[c["i"]] = c["v"]
    return {j: (v[0], v[1 : 1 + dim], v[1 + dim :].reshape(dim, dim)) for j, v in found.items()}, cost


def assign(rows: DataFrame, model: Clusters, train: str, by: str = "symbol", at: str = "date") -> DataFrame:
    """by, at, cluster. Rows with ``train`` (boolean) true lie on the best path through them; a later row takes the cluster
    in which the best path up to it ends, so nothing after it counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        costs = model.costs(np.array(pdf["x"].tolist()))
        known = int(np.append(np.flatnonzero(pdf[train].to_numpy(bool)), -1).max()) + 1
        path, _ = best_path(costs[:known], model.penalty)
        total, _ = forward(costs, model.penalty)
        return pd.DataFrame({by: pdf[by], at: pdf[at], "cluster": np.append(path, total[known:].argmin(axis=1))})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(by, at, "x", train).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {at} {kinds[at]}, cluster bigint")


class Small(NamedTuple):
    """A cluster is small if its share of the rows and its mean run both lie below these."""

    share: float = 0.02
    mean_run: float = 3.0


def small_clusters(labels: DataFrame, rule: Small, by: str = "symbol", at: str = "date") -> DataFrame:
    """cluster, n, share, mean_run, small."""
    w = Window.partitionBy(by).orderBy(at)
    runs = labels.withColumn("_new", F.coalesce((F.lag("cluster").over(w) != F.col("cluster")).cast("int"), F.lit(1)))
    out = runs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("_runs"))
    total = out.agg(F.sum("n").alias("_all"))  # one row
    out = out.crossJoin(F.broadcast(total)).select("cluster", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("n") / F.col("_runs")).alias("mean_run"))
    return out.withColumn("small", (F.col("share") < rule.share) & (F.col("mean_run") < rule.mean_run))


def fit_two_levels(rows: DataFrame, train: str, k: int, least: int, penalty: float, rule: Small = Small(), prior: float = 1.0, rounds: int = 30, by: str = "symbol", at: str = "date") -> DataFrame:
    """by, at, fine, stable, rare: a fine fit of k clusters, and one of as many as are not small in it (``least`` to k); both from training rows alone."""
    rows = materialize(rows, "regime-rows")
    known = rows.where(train)
    fine = materialize(assign(rows, fit(known, k, penalty, prior, rounds, by=by, at=at), train, by, at), "regime-fine")
    sizes = materialize(small_clusters(fine.join(known.select(by, at), [by, at]), rule, by, at), "regime-sizes")
    n_valid = sizes.where("NOT small").count()
    stable = assign(rows, fit(known, min(k, max(least, n_valid)), penalty, prior, rounds, by=by, at=at), train, by, at)
    out = fine.withColumnRenamed("cluster", "fine").join(stable.withColumnRenamed("cluster", "stable"), [by, at])
    rare = sizes.select(F.col("cluster").alias("fine"), F.col("small").alias("rare"))
    # A cluster without a training row is rare.
    return out.join(rare, "fine", "left").select(by, at, "fine", "stable", F.coalesce("rare", F.lit(True)).alias("rare"))
