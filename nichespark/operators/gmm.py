"""Gaussian mixtures by EM: sufficient statistics on the executors, small matrices on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichespark.functions.checks import need
from nichespark.runtime import settle

#: Rows that starting means are found on.
INIT_ROWS = 20_000
MAX_EPOCHS = 100


@dataclass
class Mixture:
    """Weights, means and covariances of k components."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    factors: np.ndarray = field(init=False)
    inverses: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.factors = np.linalg.cholesky(self.covariances)
        self.inverses = np.linalg.inv(self.factors)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, a column for each component."""
        out = np.empty((len(x), len(self.weights)))
        for i, (w, m, f, back) in enumerate(zip(self.weights, self.means, self.factors, self.inverses, strict=True)):
            z = (x - m) @ back.T
            out[:, i] = np.log(max(w, 1e-300)) - 0.5 * (z**2).sum(1) - np.log(np.diag(f)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights.tolist(), "means": self.means.tolist(), "covariances": self.covariances.tolist()})

    @staticmethod
    def from_json(text: str) -> Mixture:
        d = json.loads(text)
        return Mixture(np.array(d["weights"]), np.array(d["means"]), np.array(d["covariances"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _lse(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Means by k-means++ seeding and Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    means = [x[rng.integers(len(x))]]
    d = ((x - means[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = d / d.sum() if d.sum() else np.full(len(x), 1 / len(x))
        means.append(x[rng.choice(len(x), p=p)])
        d = np.minimum(d, ((x - means[-1]) ** 2).sum(1))
    m = np.array(means)
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ m.T + (m**2).sum(1)[None, :]).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else m[i] for i in range(k)])
        if np.allclose(new, m):
            break
        m = new
    return m


class GaussianMixture:
    """A mixture with full, diagonal or spherical covariances.

    fit() starts from k-means (or random rows, or given means) on a bounded sample, and runs EM until the mean
    negative log-likelihood changes by less than convergence_tolerance. All rows stay on the executors, at every
    size; the driver handles matrices of the size of the model. If a covariance has no
    Cholesky factor the ridge grows tenfold; beyond 1 that is a ValueError. batch_size is the number of rows of an
    Arrow batch that are held against the model at once; trainer_params takes max_epochs. Fitted: model_,
    converged_, num_iter_, nll_.
    """

    def __init__(self, n_clusters: int = 1, *, covariance_type: str = "full", init_strategy: str = "kmeans", init_means=None, convergence_tolerance: float = 1e-3, covariance_regularization: float = 1e-6, batch_size: int | None = None, trainer_params: dict | None = None, random_state: int = 0):
        if covariance_type not in ("full", "diag", "spherical"):
            raise ValueError(f"covariance type {covariance_type!r}")
        self.n_clusters, self.covariance_type, self.init_strategy, self.init_means = n_clusters, covariance_type, init_strategy, init_means
        self.convergence_tolerance, self.covariance_regularization = convergence_tolerance, covariance_regularization
        self.batch_size, self.trainer_params, self.random_state = batch_size, dict(trainer_params or {}), random_state

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in ("n_clusters", "covariance_type", "init_strategy", "convergence_tolerance", "covariance_regularization", "batch_size", "trainer_params", "random_state")}

    def set_params(self, values: dict) -> GaussianMixture:
        for k, v in values.items():
            setattr(self, k, v)
        return self

    def fit(self, data: DataFrame, use_rep: str = "features") -> GaussianMixture:
        need(data, use_rep)
        if isinstance(data.schema[use_rep].dataType, VectorUDT):
            raise ValueError("sparse or ML vectors aren't supported; use an array of doubles")
        rows = settle(data.select(F.col(use_rep).cast("array<double>").alias("x")).where(F.col("x").isNotNull()))
        n = rows.count()
        if n < self.n_clusters:
            raise ValueError(f"{n} rows for {self.n_clusters} clusters")
        start = self._start(rows, n)
        ridge = self.covariance_regularization
        while True:
            try:
                self._em(rows, n, start, ridge)
                self.covariance_regularization = ridge
                return self
            except np.linalg.LinAlgError:
                ridge *= 10
                if ridge > 1.5:
                    raise ValueError("no covariance could be factored; scale the data") from None

    def _start(self, rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, means and plain covariances of the first clusters, made by one task from INIT_ROWS rows at most."""
        k, seed, strategy, given = self.n_clusters, self.random_state, self.init_strategy, self.init_means
        # rows are settled, so that their numbers stay; equal rows are drawn each for itself
        drawn = rows.withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
        part = 1.5 * INIT_ROWS / n
        sample = (drawn if part >= 1 else drawn.where(F.pmod("draw", F.lit(1 << 20)) < int(part * (1 << 20)) + 1)).orderBy("draw", "x").limit(INIT_ROWS).select("x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [_matrix(b.column(0)) for b in batches if b.num_rows]
            if not found:
                return
            x = np.concatenate(found)
            d = x.shape[1]
            if given is not None:
                means = np.asarray(given, float)
            elif strategy == "kmeans":
                means = kmeans(x, k, seed)
            else:
                means = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
            near = ((x**2).sum(1)[:, None] - 2 * x @ means.T + (means**2).sum(1)[None, :]).argmin(1)
            cov = np.array([np.cov(x[near == i].T, bias=True).reshape(d, d) if (near == i).sum() > d else np.cov(x.T, bias=True).reshape(d, d) for i in range(k)])
            made = json.dumps({"sizes": np.bincount(near, minlength=k).tolist(), "means": means.tolist(), "cov": cov.tolist()})
            yield pa.RecordBatch.from_arrays([pa.array([made])], names=["made"])

        made = json.loads(sample.mapInArrow(run, "made string").first()[0])
        return np.array(made["sizes"]).clip(1), np.array(made["means"]), np.array(made["cov"])

    def _shape(self, cov: np.ndarray, ridge: float) -> np.ndarray:
        d = cov.shape[1]
        if self.covariance_type == "diag":
            cov = cov * np.eye(d)
        elif self.covariance_type == "spherical":
            cov = np.array([np.eye(d) * np.trace(c) / d for c in cov])
        return cov + ridge * np.eye(d)

    def _em(self, rows: DataFrame, n: int, start: tuple[np.ndarray, np.ndarray, np.ndarray], ridge: float) -> None:
        sizes, means, cov = start
        k, d = means.shape
        model = Mixture(sizes / sizes.sum(), means, self._shape(cov, ridge))
        before, self.converged_ = np.inf, False
        for step in range(1, int(self.trainer_params.get("max_epochs") or MAX_EPOCHS) + 1):
            s0, s1, s2, ll = self._statistics(rows, model, k, d)
            self.nll_, self.num_iter_ = -ll / n, step
            weight = s0.clip(1e-12)
            means = s1 / weight[:, None]
            cov = s2 / weight[:, None, None] - np.einsum("ki,kj->kij", means, means)
            model = Mixture(s0 / n, means, self._shape((cov + cov.transpose(0, 2, 1)) / 2, ridge))
            if abs(before - self.nll_) < self.convergence_tolerance or k == 1:
                self.converged_ = True
                break
            before = self.nll_
        self.model_ = model

    @staticmethod
    def _sums(x: np.ndarray, model: Mixture) -> np.ndarray:
        """Flat sums of responsibilities, of x and of x x' by component, then the log-likelihood."""
        p = model.log_prob(x)
        norm = _lse(p)
        r = np.exp(p - norm[:, None])
        second = np.array([((x * r[:, i : i + 1]).T @ x).ravel() for i in range(p.shape[1])])
        return np.append(np.hstack([r.sum(0)[:, None], r.T @ x, second]).ravel(), norm.sum())

    def _statistics(self, rows: DataFrame, model: Mixture, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The sums over all rows: s0, s1, s2 by component and the log-likelihood; Spark adds them up entry by entry."""
        width, size = 1 + d + d * d, self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * width + 1)
            for b in batches:
                for i in range(0, b.num_rows, size or max(1, b.num_rows)):
                    total += GaussianMixture._sums(_matrix(b.column(0).slice(i, size)), model)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["i", "v"])

        summed = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(k * width + 1)
        for r in summed:
            flat[r["i"]] = r["v"]
        t = flat[:-1].reshape(k, width)
        return t[:, 0], t[:, 1 : 1 + d], t[:, 1 + d :].reshape(k, d, d), float(flat[-1])

    def _apply(self, data: DataFrame, use_rep: str, name: str, kind: str, compute) -> DataFrame:
        model = self.model_

        def of(column: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(column), dtype=object)
            has = column.notna().to_numpy()
            if has.any():
                values = compute(model.log_prob(np.stack(column[has].to_list()).astype(float)))
                out[has] = pd.Series(list(values), index=out.index[has], dtype=object)
            return out

        return data.withColumn(name, F.pandas_udf(of, kind)(F.col(use_rep).cast("array<double>")))

    def predict(self, data: DataFrame, use_rep: str = "features", out_key: str = "cluster") -> DataFrame:
        """data with the most likely component (null for null features)."""
        return self._apply(data, use_rep, out_key, "int", lambda p: p.argmax(1))

    def predict_proba(self, data: DataFrame, use_rep: str = "features", out_key: str = "proba") -> DataFrame:
        """data with the posterior of every component."""
        return self._apply(data, use_rep, out_key, "array<double>", lambda p: np.exp(p - _lse(p)[:, None]))

    def score_samples(self, data: DataFrame, use_rep: str = "features", out_key: str = "nll") -> DataFrame:
        """data with each row's negative log-likelihood."""
        return self._apply(data, use_rep, out_key, "double", lambda p: -_lse(p))

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters and model as one JSON row."""
        row = {"params": self.get_params(), "model": json.loads(self.model_.to_json()), "nll": self.nll_, "num_iter": self.num_iter_, "converged": self.converged_}
        spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GaussianMixture:
        row = json.loads(spark.read.text(path).first()[0])
        out = cls(**row["params"])
        out.model_ = Mixture.from_json(json.dumps(row["model"]))
        out.nll_, out.num_iter_, out.converged_ = row["nll"], row["num_iter"], row["converged"]
        return out


class Cluster(GaussianMixture):
    """A mixture over cells; labels are strings "0" .. "k-1", and the parameters are kept in params_."""

    def fit(self, cells: DataFrame, use_rep: str = "X_agg") -> Cluster:
        super().fit(cells, use_rep)
        self.params_ = self.get_params()
        return self

    def predict(self, cells: DataFrame, use_rep: str = "X_agg", out_key: str = "cluster") -> DataFrame:
        return super().predict(cells, use_rep, out_key).withColumn(out_key, F.col(out_key).cast("string"))
