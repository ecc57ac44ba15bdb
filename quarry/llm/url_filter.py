"""URL filter: allow/block rules first, then logistic regression on character n-grams.

Main path: DataFrame expressions only.  The model is fitted on the driver from a
small labelled URL table (at most ``max_rows`` rows) and enters the plan as one
constant array of ``buckets`` weights, so its size never depends on the data.

Defined results: a null URL, or one without ``://``, has an empty host and path,
no rule, and the model's verdict on the empty string.  Repeated rows are judged
alike; extra columns pass through; an input column named like an output column
gives way to it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replace_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words of hosts to block, by topic, and words that stand beside them; hosts are made of one of each by rule.
BAD_WORDS = (
    ("casino", "poker", "slots", "bets", "betting", "jackpot", "roulette", "bingo", "lottery"),
    ("pills", "viagra", "steroids", "pharmacy", "miracle", "dieting"),
    ("adult", "xxx", "porn", "escort", "cams", "dating"),
    ("spam", "malware", "phishing", "warez", "crack", "keygen", "torrent"),
    ("ads", "adserver", "tracker", "tracking", "popup", "clickbait", "linkfarm"),
)
BESIDE_BAD = ("online", "king", "bonus", "club", "best", "super", "max", "zone", "hot", "vip", "deal", "now")
GOOD_WORDS = (
    ("news", "weather", "library", "school", "garden", "history", "science", "museum", "recipes", "travel"),
    ("music", "health", "forum", "archive", "journal", "university", "research", "stories", "culture", "nature"),
    ("village", "harbor", "mountain", "river", "kitchen", "photos", "theater", "painting", "reading", "printing"),
    ("maison", "jardin", "livres", "strasse", "wetter", "zeitung", "tiempo", "ciudad", "noticias", "escuela"),
)
BRANDS = 400
BESIDE_GOOD = ("online", "city", "house", "club", "best", "north", "union", "zone", "group", "local", "daily", "now")


def labelled_urls() -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 = block), made from the words above by rule."""
    rows = []
    for label, topics, beside in ((1, BAD_WORDS, BESIDE_BAD), (0, GOOD_WORDS, BESIDE_GOOD)):
        for j, word in enumerate(w for words in topics for w in words):
            for k in range(6):
                other = beside[(5 * j + 7 * k) % len(beside)]
                name = (word, f"{word}-{other}", f"{other}-{word}", f"{word}{other}", f"my-{word}", f"{word}s")[k]
                prefix = ("", "www.", "blog.", "m.")[(j + k) % 4]
                lang = ("en", "de", "fr", "es")[(label + j + 3 * k) % 4]
                tail = ("", "/", ".html")[(j + 2 * k) % 3]
                rows.append((f"{prefix}{name}.example.{('com', 'net', 'org')[(j + k) % 3]}", f"/{lang}/{37 * (j + 1) + k}{tail}", label))
    r = random.Random(11)
    for j in range(BRANDS):  # names that say nothing are to be allowed
        name = "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(("", "", "l", "n", "r", "x")) for _ in range(2 + j % 3))
        rows.append((f"{('', 'www.', 'blog.', 'm.')[j % 4]}{name}.example.{('com', 'net', 'org')[j % 3]}", f"/{('en', 'de', 'fr', 'es')[j // 4 % 4]}/{13 * j}", 0))
    return rows


@dataclass(frozen=True)
class UrlModel:
    """Weights of hashed n-grams; ``score = sigmoid(bias + mean-scaled weight sum)``."""

    weights: tuple[float, ...]
    bias: float
    n: int


def _grams(s: str, n: int) -> list[str]:
    s = f"^{s}$"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def fit(rows, n: int = 4, buckets: int = 16384, epochs: int = 1500, l2: float = 1e-5, step: float = 1.0, max_rows: int = 10_000) -> UrlModel:
    """Full-batch logistic regression with momentum.  ``rows`` are (host, path, label); more than ``max_rows`` is an error.

    An n-gram's bucket is the first 32 bits of its MD5 modulo ``buckets``, which Spark
    and SQL engines compute alike.
    """
    rows = list(itertools.islice(rows, max_rows + 1))
    if len(rows) > max_rows:
        raise ValueError(f"the labelled table is limited to {max_rows} rows")
    x, y = np.zeros((len(rows), buckets)), np.array([r[2] for r in rows], dtype=float)
    for i, (host, path, _) in enumerate(rows):
        for g in _grams(host + path, n):
            x[i, int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % buckets] += 1
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    share = np.where(y == 1, y.sum(), (1 - y).sum())  # both labels weigh alike
    w, b, speed, pace = np.zeros(buckets), 0.0, np.zeros(buckets), 0.0
    for _ in range(epochs):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) / np.maximum(2 * share, 1)
        speed = 0.95 * speed - step * (x.T @ g + l2 * w)
        pace = 0.95 * pace - step * g.sum()
        w, b = w + speed, b + pace
    return UrlModel(tuple(float(v) for v in w), float(b), n)


@functools.lru_cache(maxsize=1)
def fitted() -> UrlModel:
    """The model of the small labelled table, fitted once for the life of the process."""
    return fit(labelled_urls())


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def block_probability(host: Column, path: Column, model: UrlModel) -> Column:
    """The model as one expression: n-grams, bucket lookup in a constant array, sum, sigmoid."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))
    count = F.length(text) - (model.n - 1)
    weights = F.array(*[F.lit(w) for w in model.weights])
    grams = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(model.n))))
    at = F.transform(grams, lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(len(model.weights))).cast("int"))
    total = F.aggregate(F.transform(at, lambda i: F.get(weights, i)), F.lit(0.0), lambda a, v: a + v)
    z = F.coalesce(total / F.sqrt(F.greatest(count, F.lit(1)).cast("double")), F.lit(0.0)) + F.lit(model.bias)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # a later one is longer and wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, url: str = "url", rules=RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, p_block (model's probability) and verdict to every row."""
    model = model or fitted()
    out = replace_columns(pages, host=host_of(F.col(f"`{url}`")), path=path_of(F.col(f"`{url}`")))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    out = replace_columns(out, rule=name, p_block=F.round(block_probability(F.col("host"), F.col("path"), model), 6), verdict=verdict)
    by_model = F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return replace_columns(out, verdict=F.coalesce(F.col("verdict"), by_model))
