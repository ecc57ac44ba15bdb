"""Mixing sources to target weights with soft membership.

A softmax classifier on hashed n-grams, fitted on a bounded labelled table,
predicts each document's domain posteriors p.  With t tokens in a document and a
rate r (how often it is to be read), a domain's expected tokens are the sum of
r * t * p.  Accelerated projected-gradient least squares fits rates at or above
``least`` whose expected domain totals match the target totals.  Gaps are measured in
the norm of the domains' inverse Gram matrix, in which all directions are alike, so a
few rounds settle it (one, where no rate meets its bound).

Scale: texts are read once, where they are; what follows works on a written
table of (id, tokens, posteriors).  A rate is a function of the posteriors and
the gradients so far (one short vector a round, at most ``rounds`` of them), so a
round is one pass that returns one short vector from each task: no shuffle of
documents, no state on the driver that grows with them.  Rates start at 1 and
move only along posteriors, so documents alike in posterior get like rates.

Defined results: a null or empty text has 0 tokens, the posterior of a text
without n-grams, and a rate like any other.  Repeated rows get equal rates.  With an
empty table the result is empty.  Without any labelled text nothing is known of
domains: posteriors are empty and all rates alike.  Where some texts are labelled, a
domain that none has cannot be a target (ValueError).  ``gap`` is the largest
distance between a domain's expected and target share of the corpus' tokens (the
same in every row); above ``tolerance``, where no rates reach the targets, it
is also warned of.  Extra columns pass through, an input column named like an output
column gives way.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _grams, langid
from ._memory import trimmed
from .common import materialize

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Domains:
    names: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, raws: list[bytes]) -> np.ndarray:
        z = _grams.histograms(raws) @ self.weights + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], steps: int = 150, l2: float = 1e-4) -> Domains:
    names = tuple(sorted(set(labels)))
    y = np.array([names.index(x) for x in labels])
    x = _grams.histograms(texts) * langid.SCALE
    target = np.eye(len(names), dtype=np.float32)[y]
    w, b = np.zeros((_grams.BUCKETS, len(names)), np.float32), np.zeros(len(names), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - target) / len(y)
        vw, vb = 0.9 * vw + x.T @ g + l2 * w, 0.9 * vb + g.sum(0)
        w, b = w - 1.0 * vw, b - 0.5 * vb
    return Domains(names, w * langid.SCALE, b)


def _tokens(raw: bytes) -> int:
    inside = ~_SPACE[np.frombuffer(raw, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum()) if len(raw) else 0


def rates(p: np.ndarray, gradients: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the rounds so far, and the extrapolated point of the next round."""
    now = point = np.maximum(np.ones(len(p)), least)
    momentum = 1.0
    for g in gradients:
        new = np.maximum(least, point - p @ g)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        point = new + (momentum - 1) / after * (new - now)
        now, momentum = new, after
    return now, point


def _matrix(batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("posteriors").flatten().to_numpy(zero_copy_only=False).reshape(-1, k), batch.column("n_tokens").to_numpy().astype(float)


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    text_col: str = "text",
    label_col: str = "domain",
    key_col: str = "doc_id",
    total_factor: float | None = 1.0,
    least: float = 0.0,
    rounds: int = 100,
    tolerance: float = 1e-4,
    per_domain: int = 500,
    max_domains: int = 64,
    max_bytes: int = 20_000,
) -> DataFrame:
    """Adds n_tokens, posteriors (map of domain to probability), rate and gap to every row of ``docs``.

    ``targets`` are weights by domain (scaled to sum to 1) of ``total_factor`` times the corpus' tokens (None: one
    hundredth above the least factor at which no domain has to shrink).  ``labelled`` holds texts and their domain.
    """
    spark = docs.sparkSession
    rows = sorted((r["lang"], r["text"].encode()) for r in langid.sample(labelled, label_col, text_col, key_col, per_domain, max_domains, max_bytes))
    new = ("n_tokens", "posteriors", "rate", "gap")
    names = [c for c in docs.columns if c.lower() not in new]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    out_schema = T.StructType(list(src.schema.fields))
    out_schema.add("n_tokens", T.LongType()).add("posteriors", T.ArrayType(T.DoubleType()))
    model = fit([t for _, t in rows], [k for k, _ in rows]) if rows else Domains((), np.zeros((_grams.BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    if rows and (unknown := set(targets) - set(model.names)):
        raise ValueError(f"no labelled text for domains {sorted(unknown)}")
    k, at = len(model.names), f"c{names.index(text_col)}"

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            for a, b in _grams.groups(texts):
                raws = _grams.raw(texts[a:b])
                p = model.posteriors(raws).astype(float) if k else np.zeros((len(raws), 0))
                cols = [batch.column(c)[a:b] for c in batch.schema.names]
                extra = [pa.array([_tokens(r) for r in raws], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * k, pa.int32()), pa.array(p.ravel()))]
                yield pa.RecordBatch.from_arrays(cols + extra, names=[*batch.schema.names, "n_tokens", "posteriors"])

    held = materialize(src.mapInArrow(trimmed(run), out_schema), "posteriors")
    light = held.select("n_tokens", "posteriors")

    def sums(body, width: int) -> np.ndarray:
        """Sum over all tasks of a short vector that each makes of its rows."""

        def part(batches):
            total = np.zeros(width)
            for batch in batches:
                total += body(*_matrix(batch, k))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "x"])

        got = light.mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(width)
        for r in got:
            out[r["i"]] = r["x"]
        return out

    gradients: list[np.ndarray] = []
    gap, alike = 0.0, 1.0
    if k:
        first = sums(lambda p, t: np.concatenate([(p * t[:, None]).T @ p, [(p.T @ t)]]).ravel(), (k + 1) * k).reshape(k + 1, k)
        total = max(float(first[k].sum()), 1e-300)  # posteriors sum to 1, so this counts tokens
        share, weight = first[k] / total, np.array([targets.get(n, 0.0) for n in model.names])
        weight = weight / max(weight.sum(), 1e-300)
        if total_factor is None:
            total_factor = 1.01 * float(np.max(share / np.maximum(weight, 1e-9), where=weight > 0, initial=1.0))
        goal, whiten = weight * total_factor, np.linalg.pinv(first[:k] / total, rcond=1e-9, hermitian=True)
        point = share * max(1.0, least)
        gap = float(np.abs(point - goal).max()) if share.sum() else 0.0
        while gap > tolerance and len(gradients) < rounds:
            gradients.append(whiten @ (point - goal))
            fixed = list(gradients)
            point = sums(lambda p, t: p.T @ (t * rates(p, fixed, least)[1]), k) / total
            gap = float(np.abs(point - goal).max())
        if gap > tolerance:
            warnings.warn(f"the targets are missed by up to {gap:.4f} of the corpus' tokens", stacklevel=2)
    else:
        alike = total_factor or 1.0

    def last(batches):
        for batch in batches:
            if k:
                r = rates(_matrix(batch, k)[0], gradients, least)[1]  # the point whose gap was measured
            else:
                r = np.full(len(batch), max(least, alike))
            cols = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r)], names=[*batch.schema.names, "rate"])

    done = held.mapInArrow(last, T.StructType([*held.schema.fields, T.StructField("rate", T.DoubleType())]))
    done = done.withColumn("gap", F.lit(gap))
    keys = F.array(*[F.lit(n) for n in model.names]).cast("array<string>")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_tokens", F.map_from_arrays(keys, F.col("posteriors")).alias("posteriors"), "rate", "gap")


def repeats(rate, *key):
    """Whole number of readings of a document: the rate, rounded up with the probability of its fraction by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit("repeat"), *key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")
