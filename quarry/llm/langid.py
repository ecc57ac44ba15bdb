"""Language identification by error-correcting output codes.

Each language gets a codeword of +1/-1 bits; for each bit a binary logistic
classifier on hashed byte n-grams learns to tell the languages at +1 from those
at -1.  A text is decoded by loss: the language whose codeword has the smallest
weighted logistic loss against the classifiers' margins, where a bit counts for a
language as much as it proved right on that language's training texts.  The
nearest two codewords give the score, and a small lead flags ambiguity.

Training reads a bounded sample: about ``per_language`` texts of each of at most
``max_languages`` languages, of at most ``max_bytes`` bytes each, chosen by a
hash of the id.  Scoring covers every whole text, in place, without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
With no labelled text at all every text is ``und``.  Repeated rows are judged
alike; extra columns pass through, an input column named like an output column
gives way.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _grams

SCALE = 40.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # [languages, bits] of +1 and -1
    weights: np.ndarray  # [buckets, bits]
    bias: np.ndarray
    trust: np.ndarray  # [languages, bits]; rows sum to 1


def codebook(n: int, seed: int = 3) -> np.ndarray:
    """All distinct useful bits for up to five languages, else the best of random dense codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits], float).T
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), size=(n, bits))
        far = ((bits - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min()
        if far > best[0] and (np.abs(code.sum(0)) < n).all():
            best = (far, code)
    return best[1]


def fit(texts: list[bytes], languages: list[str], steps: int = 150, l2: float = 1e-4) -> Model:
    names = tuple(sorted(set(languages)))
    code = codebook(len(names))
    y = np.array([names.index(x) for x in languages], int)
    x = _grams.histograms(texts) * SCALE
    share = np.bincount(y, minlength=max(1, len(names)))[y] if len(y) else np.ones(0)
    w = (1 / np.maximum(share, 1) / max(1, len(names))).astype(np.float32)[:, None]  # languages weigh alike
    target = (code[y] > 0).astype(np.float32)
    a, b = np.zeros((_grams.BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    va, vb = np.zeros_like(a), np.zeros_like(b)
    for _ in range(steps if len(names) > 1 else 0):
        g = (1 / (1 + np.exp(-np.clip(x @ a + b, -30, 30))) - target) * w
        va, vb = 0.9 * va + x.T @ g + l2 * a, 0.9 * vb + g.sum(0)
        a, b = a - 1.0 * va, b - 0.5 * vb
    right = (np.sign(x @ a + b) == np.sign(code[y])).astype(float) if len(y) else np.zeros((0, code.shape[1]))
    trust = np.array([right[y == k].mean(0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(names))]).reshape(len(names), code.shape[1])
    return Model(names, code, a, b, trust / np.maximum(trust.sum(1, keepdims=True), 1e-9))


def decode(model: Model, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its score, and its lead over the next (0 to 1)."""
    margin = _grams.histograms(raws) @ (model.weights * SCALE) + model.bias
    loss = np.logaddexp(0, -model.code[None] * margin[:, None, :])
    total = (loss * model.trust[None]).sum(2)
    p = np.exp(-(total - total.min(1, keepdims=True)) * 4)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, axis=1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def sample(docs: DataFrame, lang: str, text: str, key: str, per_language: int, max_languages: int, max_bytes: int):
    """The bounded training sample as a list of rows (text, lang), the same in every run.  Too many labels are an error."""
    able = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    able = able.filter("lang is not null and text is not null")
    found = able.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} labels")
    if not found:
        return []
    rate = F.create_map(*[F.lit(v) for r in found for v in (r["lang"], min(1.0, per_language / r["count"]))])
    u = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) / float(1 << 20)
    chosen = able.filter((u < rate[F.col("lang")]) & (F.octet_length("text") <= max_bytes)).withColumn("u", u / rate[F.col("lang")])
    return chosen.orderBy("u", "key", "lang", F.xxhash64("text"), "text").limit(2 * per_language * len(found)).select("text", "lang").collect()


def identify(
    docs: DataFrame,
    train: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    per_language: int = 600,
    max_languages: int = 200,
    max_bytes: int = 20_000,
    lead: float = 0.2,
) -> DataFrame:
    """Adds lang_pred, score and ambiguous to ``docs``; learns from ``train``'s text and language columns only."""
    rows = sorted((r["lang"], r["text"].encode()) for r in sample(train, lang_col, text_col, key_col, per_language, max_languages, max_bytes))
    model = fit([t for _, t in rows], [k for k, _ in rows])
    new = ("lang_pred", "score", "ambiguous")
    names = [c for c in docs.columns if c.lower() not in new]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text_col)}"

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            for a, b in _grams.groups(texts):
                part = texts[a:b]
                able = [any(map(str.isalpha, t or "")) for t in part.to_pylist()]
                if model.languages and any(able):
                    best, score, gap = decode(model, _grams.raw(part))
                    lang = [model.languages[k] if ok else "und" for k, ok in zip(best, able, strict=True)]
                    score, low = np.where(able, score, 0.0), np.where(able, gap < lead, True)
                else:
                    lang, score, low = ["und"] * (b - a), np.zeros(b - a), np.ones(b - a, bool)
                cols = [batch.column(c)[a:b] for c in batch.schema.names]
                extra = [pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(low.astype(bool))]
                yield pa.RecordBatch.from_arrays(cols + extra, names=[*batch.schema.names, *new])

    schema = T.StructType(list(src.schema.fields))
    schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("ambiguous", T.BooleanType())
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *new)
