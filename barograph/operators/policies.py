"""Actions of trained policies: weights shipped as one file, read once by each worker, applied to batches as matrix products.

The file is an .npz archive. Of agent a it holds the arrays ``a/W0``, ``a/b0``, ``a/W1``, ... (a layer's weights as outputs by inputs, and its
bias), optionally ``a/mu`` and ``a/sd`` of the observations. A hidden layer and the last one end in tanh. A policy
that is missing or does not fit its observations gives 0 and says why; it stops no other.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = "action double, problem string"


class Policy(NamedTuple):
    layers: list[tuple[np.ndarray, np.ndarray]]
    mu: np.ndarray | float
    sd: np.ndarray | float

    def act(self, obs: np.ndarray) -> np.ndarray:
        """One action for each row of observations."""
        x = (obs - self.mu) / self.sd
        for weights, bias in self.layers:
            x = np.tanh(x @ weights.T + bias)
        return x[:, 0]


def to_bytes(policies: dict[str, Policy]) -> bytes:
    """The archive."""
    arrays = {}
    for agent, p in policies.items():
        for i, (w, b) in enumerate(p.layers):
            arrays |= {f"{agent}/W{i}": w, f"{agent}/b{i}": b}
        arrays |= {f"{agent}/mu": np.asarray(p.mu), f"{agent}/sd": np.asarray(p.sd)}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def save(spark: SparkSession, policies: dict[str, Policy], path: str) -> str:
    """Writes the archive where the executors can be sent it from: a local path, or any that Spark's file systems know."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(to_bytes(policies)))
    out.close()
    return path


@lru_cache(maxsize=4)
def load(path: str) -> dict[str, Policy | str]:
    """Policies by agent; in place of a damaged one what is wrong with it."""
    out: dict[str, Policy | str] = {}
    with np.load(path) as data:
        for agent in sorted({k.rsplit("/", 1)[0] for k in data.files}):
            try:
                layers = []
                while f"{agent}/W{len(layers)}" in data.files:
                    n = len(layers)
                    w = np.atleast_2d(np.asarray(data[f"{agent}/W{n}"], float))
                    b = np.asarray(data[f"{agent}/b{n}"], float).reshape(-1) if f"{agent}/b{n}" in data.files else np.zeros(len(w))
                    if len(b) != len(w) or (layers and w.shape[1] != len(layers[-1][1])):
                        raise ValueError(f"layer {n} does not fit")
                    layers.append((w, b))
                if not layers:
                    raise ValueError("no weights")
                if not all(np.isfinite(x).all() for layer in layers for x in layer):
                    raise ValueError("weights are not finite")
                mu, sd = (np.asarray(data[f"{agent}/{k}"], float) if f"{agent}/{k}" in data.files else v for k, v in (("mu", 0.0), ("sd", 1.0)))
                out[agent] = Policy(layers, mu, np.where(sd == 0, 1.0, sd))
            except ValueError as e:
                out[agent] = str(e)
    return out


def _run(find: Callable[[], str], limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policies = load(find())
        for batch in batches:
            agents, lists = batch.column("_agent").to_pylist(), batch.column("_obs")
            action, problem = np.zeros(batch.num_rows), np.array([None] * batch.num_rows, dtype=object)
            sizes = np.array([-1 if x is None else x for x in lists.value_lengths().to_pylist()])
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(agents, sizes.tolist(), strict=True)):
                by.setdefault(key, []).append(i)
            for (agent, size), rows in by.items():
                p = policies.get(agent, "no policy")
                if isinstance(p, Policy) and size != p.layers[0][0].shape[1]:
                    p = f"{max(size, 0)} observations, {p.layers[0][0].shape[1]} expected"
                if isinstance(p, str):
                    problem[rows] = p
                    continue
                obs = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)
                action[rows] = np.clip(p.act(np.nan_to_num(obs, nan=0.0, posinf=0.0, neginf=0.0)), -limit, limit)
            names = [c for c in batch.schema.names if c not in ("_agent", "_obs")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(action), pa.array(problem.tolist(), pa.string())], [*names, "action", "problem"])

    return run


def act(df: DataFrame, agent: str, observations: list[str | Column], path: str, limit: float = 1.0) -> DataFrame:
    """Adds action (clipped to the limit) and problem (null where there was none). ``path``: the file of policies, on the driver.

    Null, NaN and infinite observations count as 0. Rows stay in their partitions, so agents are wherever the rows are.
    """
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    obs = F.array(*[(F.col(o) if isinstance(o, str) else o).cast("double") for o in observations])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], ACTIONS])
    return df.withColumns({"_agent": F.col(agent).cast("string"), "_obs": obs}).mapInArrow(_run(lambda: SparkFiles.get(name), limit), schema)
