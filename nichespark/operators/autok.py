"""The number of clusters by the stability of repeated clusterings."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichespark.operators import stability as st
from nichespark.operators.gmm import Cluster
from nichespark.runtime import settle


def _name(thing: type | Callable) -> str:
    if "<" in thing.__qualname__:
        raise ValueError(f"{thing.__qualname__} can't be saved, as it can't be imported")
    return f"{thing.__module__}:{thing.__qualname__}"


def _named(name: str) -> type | Callable:
    module, _, path = name.partition(":")
    out = importlib.import_module(module)
    for part in path.split("."):
        out = getattr(out, part)
    return out


class ClusterAutoK:
    """Fit every number of clusters several times, keep the best model of each, and score stability.

    n_clusters: (a, b) makes max(1, a - 1) .. b + 1; a list is used as it is. A new run's labels
    at k are compared with those of every earlier run at k + 1. Runs end early once the mean
    stability changes by less than convergence_tol (mean absolute percentage error).
    similarity_function takes a contingency table (see stability.contingency) and returns keys
    and value. Fitted: best_models, labels (run, k, cell_id, label), stability.
    """

    def __init__(self, n_clusters: tuple[int, int] | list[int], max_runs: int = 10, convergence_tol: float = 1e-2, model_class: type | None = None, model_params: dict | None = None, similarity_function: Callable[[DataFrame], DataFrame] | None = None):
        self.n_clusters = list(range(max(1, n_clusters[0] - 1), n_clusters[1] + 2)) if isinstance(n_clusters, tuple) else sorted(n_clusters)
        self.max_runs, self.convergence_tol = max_runs, convergence_tol
        self.model_class, self.model_params = model_class or Cluster, dict(model_params or {})
        self.similarity_function = similarity_function or st.fowlkes_mallows
        self.best_models: dict[int, object] = {}
        self.labels: DataFrame | None = None
        self.stability: DataFrame | None = None

    def get_params(self) -> dict:
        return {"n_clusters": self.n_clusters, "max_runs": self.max_runs, "convergence_tol": self.convergence_tol, "model_params": self.model_params}

    def set_params(self, values: dict) -> ClusterAutoK:
        for k, v in values.items():
            setattr(self, k, v)
        return self

    def fit(self, cells: DataFrame, use_rep: str | None = None) -> ClusterAutoK:
        rep = use_rep or ("X_agg" if "X_agg" in cells.columns else "features")
        rows = settle(cells.select("cell_id", rep))
        seed, params = int(self.model_params.get("random_state", 0)), {k: v for k, v in self.model_params.items() if k != "random_state"}
        before = None
        for run in range(self.max_runs):
            for k in self.n_clusters:
                model = self.model_class(n_clusters=k, random_state=seed + run, **params).fit(rows, rep)
                if k not in self.best_models or model.nll_ < self.best_models[k].nll_:
                    self.best_models[k] = model
                got = model.predict(rows, rep, "label").select(F.lit(run).alias("run"), F.lit(k).alias("k"), "cell_id", F.col("label").cast("int"))
                got = settle(got)
                self.labels = got if self.labels is None else self.labels.unionByName(got)
            if run:
                self.stability = settle(self.similarity_function(st.contingency(self.labels)))
                now = settle(st.mean_stability(self.stability))
                if before is not None and (e := st.mape(before, now).first()["mape"]) is not None and e < self.convergence_tol:
                    break
                before = now
        return self

    def mirrored(self) -> DataFrame:
        if self.max_runs <= 1:
            raise ValueError("stability needs more than one run")
        return st.mirror(self.stability)

    @property
    def best_k(self) -> int:
        """The interior k with the highest mean stability."""
        return st.best_k(st.mean_stability(self.mirrored())).first()["k"]

    @property
    def peaks(self) -> list[int]:
        return [r["k"] for r in st.peaks(st.mean_stability(self.mirrored())).orderBy("k").collect()]

    @property
    def persistent_attributes(self) -> list[str]:
        return ["labels", "stability"]

    def predict(self, cells: DataFrame, use_rep: str | None = None, k: int | None = None, out_key: str = "cluster") -> DataFrame:
        rep = use_rep or ("X_agg" if "X_agg" in cells.columns else "features")
        return self.best_models[k or self.best_k].predict(cells, rep, out_key)

    def save(self, path: str, best_k: bool = False) -> None:
        """A folder of JSON parameters, Parquet labels and stability, and a folder per model."""
        spark = self.labels.sparkSession
        ks = [self.best_k] if best_k else sorted(self.best_models)
        made = {**self.get_params(), "kept": ks, "model_class": _name(self.model_class), "similarity_function": _name(self.similarity_function)}
        spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
        for name in self.persistent_attributes:
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        for k in ks:
            self.best_models[k].save(spark, f"{path}/best_models/{self.model_class.__name__}_k{k}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, model_class: type | None = None) -> ClusterAutoK:
        """What save() wrote. The model class (unless given) and the similarity are imported by their names; only load what you trust."""
        params = json.loads(spark.read.text(f"{path}/params").first()[0])
        kept, saved = params.pop("kept"), params.pop("model_class")
        out = cls(**{**params, "similarity_function": _named(params["similarity_function"])}, model_class=model_class or _named(saved))
        out.labels, out.stability = spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/stability")
        out.best_models = {k: out.model_class.load(spark, f"{path}/best_models/{out.model_class.__name__}_k{k}") for k in kept}
        return out
