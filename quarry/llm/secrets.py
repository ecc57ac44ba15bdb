"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are runs of 20 or more key characters inside a word, and shorter ones,
of 8 or more characters, that are assigned (after ``=`` or ``:``) beside a key word such as
``password``.  Each gets features of its length, character transitions, dictionary coverage, path and
neighbouring words; a random forest, trained from labelled findings that a seeded
rule writes, gives the probability that it is a secret.

Main path: DataFrame and SQL expressions only.  The forest enters the plan as one
CASE expression of fixed size.  Training findings (a bounded number) go through
the very same feature expressions.  No shuffle; a text of any length is split in
place, only its candidates and their neighbours become rows.

Defined results: null, empty and candidate-free texts give no rows.  Repeated
rows give repeated rows.  ``word_index`` counts the text's words from 0, ``part`` the
candidates of a word from 0.  Extra columns are not carried; join on the id.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A value that is assigned in its own word, or that makes up a word (perhaps quoted) after an assignment.
ASSIGNED = r"""[=:]+["'`]?([^\s"'`=:;,]{8,})"""
ALONE = r"""^["'`]?([^\s"'`=:;,]{8,})"""
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
KEY_WORDS = r"(token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key|signature)"
COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|qu|ei|un|ie|ge|ci|do|la|el|os"
DICTIONARY = "tion|ment|ing|that|with|this|from|ble|heit|keit|lich|sch|eau|eux|mente|cion|ado|index|html|page|user|test|example|data|file|image|http|https|www|com|org|net|and|the|for|are|here|there|ent|ion|ate|ver|elle|pour|des|les|una|los|las|der|die|das|und|ein|name|value|function|class|get|set|list|config"
FEATURES = ("length", "turns", "digits", "upper", "other", "distinct", "hex", "pairs", "words", "path", "key_word", "assigned", "quoted")


def _share(c: Column, pattern: str) -> Column:
    """Share of the string's characters that the pattern takes away."""
    return F.lit(1.0) - F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def features(df: DataFrame) -> DataFrame:
    """Adds the feature columns; needs before2, before1, word and candidate."""
    c, n = F.col("candidate"), F.length("candidate")
    kinds = F.translate(c, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    head = F.expr("substring_index(word, candidate, 1)")
    near = F.lower(F.concat_ws(" ", "before2", "before1", head))
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return df.select(
        "*",
        F.least(n, F.lit(200)).cast("double").alias("length"),
        ((runs - 1) / F.greatest(n - 1, F.lit(1))).alias("turns"),
        _share(c, "[0-9]").alias("digits"),
        _share(c, "[A-Z]").alias("upper"),
        _share(c, "[^A-Za-z0-9]").alias("other"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64))).alias("distinct"),
        _share(c, "[0-9a-f]").alias("hex"),
        (F.regexp_count(F.lower(c), F.lit(f"(?=({COMMON_PAIRS}))")) / n).alias("pairs"),
        _share(F.lower(c), f"({DICTIONARY})").alias("words"),
        _share(F.col("word"), r"[/.\\]").alias("path"),
        flag(near.rlike(KEY_WORDS)).alias("key_word"),
        flag(head.rlike("[=:]") | F.col("before1").rlike(r"[=:]$")).alias("assigned"),
        flag(head.rlike(r"[\"'`]$")).alias("quoted"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, word_index, part, before2, before1, word, candidate."""
    text = F.col(f"`{text_col}`")
    some = docs.filter(text.rlike(f"{CANDIDATE}|(?i:{KEY_WORDS})")).select(F.col(f"`{id_col}`").alias("id"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"))
    before = lambda i, k: F.coalesce(F.get("words", i - k), F.lit(""))

    def short(w: Column, i: Column) -> Column:
        """The word is, or ends in, a shorter value that is assigned beside a key word."""
        named = F.lower(F.concat_ws(" ", before(i, 2), before(i, 1), w)).rlike(KEY_WORDS)
        return (F.length(w) >= 8) & (w.rlike(ASSIGNED) | (before(i, 1).rlike(r"[=:]$") & w.rlike(ALONE))) & named

    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: ((F.length(x["w"]) >= 20) & x["w"].rlike(CANDIDATE)) | short(x["w"], x["i"]))
    near = F.transform(at, lambda x: F.struct(x["i"].alias("word_index"), before(x["i"], 2).alias("before2"), before(x["i"], 1).alias("before1"), x["w"].alias("word")))
    long = F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1)
    value = F.when(F.col("word").rlike(ASSIGNED), F.regexp_extract("word", ASSIGNED, 1)).otherwise(F.regexp_extract("word", ALONE, 1))
    found = F.when(F.col("word").rlike(CANDIDATE), long).otherwise(F.array(value))
    return some.select("id", F.inline(near)).select("id", "word_index", "before2", "before1", "word", F.posexplode(found).alias("part", "candidate"))


def labelled_findings(n: int = 1200, seed: int = 5) -> list[dict]:
    """Labelled findings written by rule: before2, before1, word, candidate, label (1: a secret)."""
    r = random.Random(seed)
    draw = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    base64 = LOWER + UPPER + DIGITS + "+/"
    pieces = "house river garden market office travel summer winter paper window maison jardin livre travail haus stadt garten zeit casa tiempo mundo trabajo under over inter super pre post able ness".split()
    letters = LOWER + UPPER + DIGITS
    word = lambda lo, hi: "".join(r.choice(pieces) for _ in range(r.randint(lo, hi)))

    def long_word(join: str = "") -> str:
        s = word(2, 4)
        while len(s) < 20:
            s += join + word(1, 3)
        return s

    secret = [lambda: draw("0123456789abcdef", r.choice((24, 32, 48, 64))), lambda: draw("0123456789ABCDEF", 32), lambda: draw(base64, r.choice((24, 40, 44, 64))), lambda: "AKIA" + draw(UPPER + DIGITS, 16), lambda: "ghp_" + draw(LOWER + UPPER + DIGITS, 36), lambda: "sk-" + draw(LOWER + UPPER + DIGITS, 32)]
    secret += 3 * [lambda: draw(letters + "!#$%&*.~-", r.randint(8, 19)), lambda: draw(letters, r.randint(10, 19)), lambda: word(1, 1)[:5].capitalize() + draw(DIGITS, r.randint(3, 6)) + draw("!#$%&*", 1)]
    plain = [
        long_word,
        lambda: long_word().capitalize(),
        lambda: long_word().upper(),
        lambda: long_word("_"),
        lambda: long_word("-"),
        lambda: "/" + "/".join(word(1, 3) for _ in range(6)),
        lambda: "//www/" + long_word("/"),
        lambda: r.choice("-=_/") * r.randint(20, 60),
        lambda: draw(r.choice((LOWER[:2], DIGITS[:2])), 1) * r.randint(20, 40),
        lambda: "get" + "".join(word(1, 2).capitalize() for _ in range(6)),
        lambda: (word(1, 2) + "required")[: r.randint(8, 19)],
        lambda: (word(2, 3) + "value").capitalize()[: r.randint(8, 19)],
        lambda: "<" + word(1, 2)[:12] + "here>",
        lambda: "*" * r.randint(8, 16),
        lambda: f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{r.randint(10, 23)}-{r.randint(10, 59)}-{word(1, 1)}",
    ]
    keys = ("token", "api_key", "secret", "password", "SECRET_KEY", "auth", "access-key")
    rows = []
    for _ in range(n):
        label = int(r.random() < 0.5)
        c = r.choice(secret if label else plain)()
        c += "-" * (8 - len(c))
        u, quote = r.random(), r.choice(('"', "'", ""))
        short = 0.45 if len(c) < 20 else 0.0  # shorter ones are candidates only beside a key word
        if u < (0.6 if label else 0.08 + short):
            before2, before1, head = r.choice(keys), r.choice(("=", ":")), quote
        elif u < (0.85 if label and not short else 1.0 if short else 0.16):
            before2, before1, head = word(1, 2), word(1, 2), r.choice(keys) + r.choice(("=", ":")) + quote
        else:
            before2, before1, head = word(1, 2), word(1, 3), r.choice(("", "", "", quote, "https:"))
        rows.append({"before2": before2, "before1": before1, "word": head + c + quote, "candidate": c, "label": label})
    return rows


class Forest:
    """A random forest for two classes; a tree is nested (feature, cut, below, above) or a leaf probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[at], y[at], depth, rng))

    def _grow(self, x, y, depth, rng):
        p = float((y.sum() + 0.5) / (len(y) + 1))
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return p
        best = (1e-6, None)
        gini = lambda s, n: 2 * s * (n - s) / np.maximum(n, 1)
        whole = gini(y.sum(), len(y))
        for f in rng.choice(x.shape[1], 5, replace=False):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19))):
                low = x[:, f] <= cut
                k = low.sum()
                if 0 < k < len(y):
                    gain = whole - gini(y[low].sum(), k) - gini(y[~low].sum(), len(y) - k)
                    if gain > best[0]:
                        best = (gain, (int(f), float(cut)))
        if best[1] is None:
            return p
        f, cut = best[1]
        low = x[:, f] <= cut
        return (f, cut, self._grow(x[low], y[low], depth - 1, rng), self._grow(x[~low], y[~low], depth - 1, rng))

    def sql(self) -> str:
        def of(t):
            return f"{t!r}D" if isinstance(t, float) else f"CASE WHEN {FEATURES[t[0]]} <= {t[1]!r}D THEN {of(t[2])} ELSE {of(t[3])} END"

        return "(" + " + ".join(of(t) for t in self.trees) + f") / {len(self.trees)}D"


@functools.lru_cache(maxsize=4)
def _fitted(spark: SparkSession, n: int, seed: int) -> str:
    kind = "array<struct<before2:string,before1:string,word:string,candidate:string,label:int>>"
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(labelled_findings(n, seed))), kind)))
    got = features(rows).select("label", *FEATURES).collect()  # n rows
    x = np.array([[r[f] for f in FEATURES] for r in got], float)
    return Forest(x, np.array([r["label"] for r in got], float)).sql()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, findings: int = 1200, seed: int = 5) -> DataFrame:
    """Every candidate with its probability; those below ``threshold`` are marked as false positives."""
    forest = _fitted(docs.sparkSession, findings, seed)
    rows = features(candidates(docs, id_col, text_col)).withColumn("p_secret", F.expr(forest))
    return rows.select("id", "word_index", "part", F.col("candidate").alias("secret"), "p_secret", (F.col("p_secret") >= threshold).alias("is_secret"))
