"""Regression by a feed-forward network: Adam on the gradient that all tasks sum up.

The network is small and lives on the driver; a step is one pass over the rows,
in which each task adds up its rows' gradient in numpy and sends one vector as
long as the network.  Rows are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Network:
    """Weights and biases by layer; inputs are scaled to [0, 1] by ``low`` and ``span``."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    low: np.ndarray
    span: np.ndarray

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The scaled input and each layer's output; hidden layers are rectified."""
        out = [(x - self.low) / self.span]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0.0) if k + 1 < len(self.layers) else z)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient of the summed squared error (flat, layer by layer), and that error."""
        out = self.forward(x)
        off = out[-1][:, 0] - y
        back, parts = 2.0 * off[:, None], []
        for k in range(len(self.layers) - 1, -1, -1):
            parts = [(out[k].T @ back).ravel(), back.sum(0), *parts]
            if k:
                back = (back @ self.layers[k][0].T) * (out[k] > 0)
        return np.concatenate(parts), float(off @ off)

    def moved(self, flat: np.ndarray) -> Network:
        layers, at = [], 0
        for w, b in self.layers:
            step_w, at = flat[at : at + w.size].reshape(w.shape), at + w.size
            step_b, at = flat[at : at + b.size], at + b.size
            layers.append((w + step_w, b + step_b))
        return Network(tuple(layers), self.low, self.span)


def _table(batch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], 1)


def fit(train: DataFrame, features: list[str], label: str = "stars", hidden: tuple[int, ...] = (32, 16), epochs: int = 25, rate: float = 0.05, seed: int = 0) -> Network:
    """Full-batch Adam on the squared error, one job an epoch; null features count as 0, rows with a null label are left out."""
    rows = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("_y")).filter("_y is not null")
    edges = rows.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(features)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(features)], F.avg("_y").alias("mean"), F.count("*").alias("n")).first()  # one row
    n = max(1, edges["n"])
    low = np.array([edges[f"a{i}"] or 0.0 for i in range(len(features))])
    span = np.array([(edges[f"b{i}"] or 0.0) - x or 1.0 for i, x in enumerate(low)])
    rng, sizes = np.random.default_rng(seed), [len(features), *hidden, 1]
    layers = [(rng.standard_normal((a, b)) * np.sqrt(2.0 / a), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    layers[-1] = (layers[-1][0] * 0.1, np.full(1, edges["mean"] or 0.0))
    net = Network(tuple(layers), low, span)
    size = sum(w.size + b.size for w, b in layers)
    first, second = np.zeros(size), np.zeros(size)
    for epoch in range(1, epochs + 1):

        def part(batches, net=net):
            total = np.zeros(size)
            for batch in batches:
                total += net.gradient(_table(batch, features), batch.column("_y").to_numpy())[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "g"])

        summed = rows.mapInArrow(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # as long as the network
        g = np.zeros(size)
        for r in summed:
            g[r["i"]] = r["g"] / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        net = net.moved(-rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8))
    return net


def predict(net: Network, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``prediction``."""
    names = [c for c in rows.columns if c != "prediction"]
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)] + [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    src = rows.select(*inner)
    at = [f"x{i}" for i in range(len(features))]

    def run(batches):
        for batch in batches:
            y = net.forward(_table(batch, at))[-1][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y)], names=[*batch.schema.names, "prediction"])

    out = src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("prediction", T.DoubleType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "prediction")
